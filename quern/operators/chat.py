"""Conversations: ordered messages, attachments on the last user message.

A conversation stays in rows, one per part of a message, because one
conversation may be very large.  Ordered by ``turn`` and ``part`` the parts of a
message joined together are its content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import attachment_text, extension

# Heading above attached files, image extensions, request limit.
ATTACHED_HEADING = "\n\n--- Attached Files ---\n"
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp")
MAX_REQUEST_BYTES = 10 * 1024 * 1024
# Media types by extension; images of other kinds are sent as JPEG.
IMAGE_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp"}
# Bytes of JSON around one part of a message.
MESSAGE_OVERHEAD = 40


def attachment_blocks(attachments: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Add ``block``: file name and fenced text, cut after 10 000 characters."""
    ext = F.lower(extension(F.col(name)))
    tag = F.coalesce(F.nullif(F.substring(ext, F.lit(2), F.char_length(ext)), F.lit("")), F.lit("text"))
    block = F.concat(
        F.lit("\nFile: "), F.col(name), F.lit("\n```"), tag, F.lit("\n"), attachment_text(F.col(text)), F.lit("\n```\n")
    )
    return attachments.filter(~ext.isin(*IMAGE_EXTENSIONS)).withColumn("block", block)


def last_user_turn(messages: DataFrame) -> DataFrame:
    """Turn of the last user message per conversation; combined before the shuffle."""
    return messages.filter(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("turn"))


def attach(messages: DataFrame, attachments: DataFrame, order: str) -> DataFrame:
    """Message parts ``(conv_id, turn, part, role, text)``.

    Part -1 is the message itself; the last user message of a conversation with
    files carries the heading and then one part per file, numbered by ``order``.
    """
    blocks = attachment_blocks(attachments).select("conv_id", F.col(order).cast("bigint").alias("part"), F.col("block").alias("text"))
    with_files = blocks.select("conv_id").distinct()
    last = last_user_turn(messages).join(with_files, "conv_id").withColumn("_last", F.lit(True))
    own = messages.join(last, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.lit(-1).cast("bigint").alias("part"), "role",
        F.when(F.col("_last"), F.concat("text", F.lit(ATTACHED_HEADING))).otherwise(F.col("text")).alias("text"),
    )
    files = blocks.join(last.drop("_last"), "conv_id").select("conv_id", "turn", "part", F.lit("user").alias("role"), "text")
    return own.unionByName(files)


def image_urls(attachments: DataFrame, name: str = "name", data: str = "data") -> DataFrame:
    """Attached images with ``url``, their bytes as a data URL; other attachments and images without bytes are left out."""
    ext = F.lower(extension(F.col(name)))
    kind = F.lit("image/jpeg")
    for known, media in IMAGE_TYPES.items():
        kind = F.when(ext == known, media).otherwise(kind)
    # Unbroken base64, as JSON wants it.
    code = F.regexp_replace(F.base64(F.col(data)), r"\s", "")
    shown = attachments.filter(ext.isin(*IMAGE_EXTENSIONS) & F.col(data).isNotNull())
    return shown.withColumn("url", F.concat(F.lit("data:"), kind, F.lit(";base64,"), code))


def message_json(parts: DataFrame, images: DataFrame, order: str) -> DataFrame:
    """One row per message ``(conv_id, turn, role, message)``: its JSON, parts joined, images on the last user message.

    ``images`` comes from ``image_urls``.  A message with images has a list as its
    content, the text first and then the images by ``order``; any other a text.  Rows
    are messages, so a conversation of any size stays spread.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    messages = parts.groupBy("conv_id", "turn", "role").agg(F.array_join(texts, "").alias("content"))
    last = last_user_turn(parts).withColumn("role", F.lit("user"))
    urls = F.transform(F.array_sort(F.collect_list(F.struct(order, "url"))), lambda i: i["url"])
    shown = images.groupBy("conv_id").agg(urls.alias("urls")).join(last, "conv_id")
    text = F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))
    pictures = F.transform("urls", lambda u: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("image_url")))
    rich = F.to_json(F.struct("role", F.concat(F.array(text), pictures).alias("content")))
    plain = F.to_json(F.struct("role", "content"))
    joined = messages.join(shown, ["conv_id", "turn", "role"], "left")
    return joined.select("conv_id", "turn", "role", F.when(F.col("urls").isNull(), plain).otherwise(rich).alias("message"))


def request_bodies(parts: DataFrame, max_bytes: int = MAX_REQUEST_BYTES) -> DataFrame:
    """One row per conversation with its messages in order.

    A body over the request limit is refused by the endpoint, so only the
    conversations below it are put together; the others come back as
    ``too_large`` with their size and no messages.
    """
    sizes = parts.groupBy("conv_id").agg(F.sum(F.octet_length("text") + MESSAGE_OVERHEAD).alias("bytes"))
    sizes = sizes.withColumn("too_large", F.col("bytes") > max_bytes)
    fitting = parts.join(sizes.filter(~F.col("too_large")), "conv_id")
    # Parts to messages, then messages to conversations: both on rows that lie together by conversation.
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    messages = fitting.groupBy("conv_id", "turn", "role").agg(
        F.first("bytes").alias("bytes"), F.min("part").alias("part"), F.array_join(texts, "").alias("content"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "part", "role", "content")))
    bodies = messages.groupBy("conv_id").agg(F.first("bytes").alias("bytes"), ordered.alias("_messages"))
    turns = F.transform("_messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    done = bodies.select("conv_id", "bytes", F.lit(False).alias("too_large"), turns.alias("messages"))
    refused = sizes.filter("too_large").select(
        "conv_id", "bytes", "too_large", F.lit(None).cast("array<struct<role:string,content:string>>").alias("messages")
    )
    return done.unionByName(refused)
