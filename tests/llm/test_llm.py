"""Every operator of the folder against a brute-force version, on odd rows and on the smallest tables."""

import base64
import hashlib
import os
import re
import time
import zlib
from collections import defaultdict

import corpus_pipeline as pipeline
import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from quern.llm import best_fit, bpe, content_sort, edit_lines, entropy_scan, factor_toxicity, projections, quadratic_quality, shuffle_shards, trie_join
from quern.session import shared_folder

SF = "/root/testdata/sf0.001"
BLANK = re.compile("[\x20\x09-\x0d]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: Nulls in every column, empty and long texts, ties, repeated rows, and columns named like those that operators make.
ROWS = [
    (1, "a b  c\td e", 7), (2, "a b c d e", 7), (3, "a b c d e", None), (3, "a b c d e", None), (4, "", 1), (5, None, 1), (None, None, 2),
    (None, "alone é 漢", 3), (6, "x", 4), (7, LONG, 5), (8, LONG + " ", 5), (9, LONG.replace("word5 ", "ward5 ", 1), 6), (10, "X", 4), (-11, "password=abcdef123456xyz", 0),
]
SCHEMA = "doc_id long, text string, part int, shard int, row string, fp string, lang string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, p, 3, "r", "f", None, len(t) if t else None) for i, t, p in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


# Exact dedup.

def test_content_sort_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(db.execute(content_sort_check()).fetchall())
    assert sorted(map(tuple, content_sort.op4(spark, SF).collect())) == want


def content_sort_check():
    from quern.llm.registry import CHECKS

    return CHECKS["op4_content_sort"]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_content_sort_odd_rows(spark, docs, none, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = content_sort.exact_duplicates(docs).collect()
        kept = content_sort.drop_exact_duplicates(docs)
        assert kept.columns == docs.columns
        kept = kept.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[BLANK.sub(" ", t or "")].append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(found) == len(ROWS)
    for r in found:
        ids = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min((i for i in ids if i is not None), default=None), len(ids))
    assert sum(r.kept for r in found) == len(groups) == len(kept)
    assert {r.doc_id for r in kept} == {min((i for i in v if i is not None), default=None) for v in groups.values()}
    assert content_sort.exact_duplicates(none).count() == content_sort.drop_exact_duplicates(none).count() == 0


def test_content_sort_cuts_a_hot_text(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 500)).alias("text"))
        found = content_sort.exact_duplicates(df)
        hot = found.where("keep_id = 0").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(hot) == 667 and {r.group_size for r in hot} == {667} and sum(r.kept for r in hot) == 1


# SimHash.

def brute_fingerprint(text):
    words = [w for w in BLANK.split(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_trie_join_on_documents(spark, texts):
    found = {r.doc_id: r for r in trie_join.op1(spark, SF).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in found.items()} == components(ids, linked)


def test_trie_join_odd_rows(docs, none):
    found = trie_join.near_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    by = {r.id: r for r in found if r.id is not None}
    assert by[4].fp == by[5].fp == 0 and by[5].component_id == by[4].component_id
    assert by[2].component_id == by[3].component_id == by[1].component_id == 1 and by[8].component_id == 7
    assert trie_join.near_duplicates(none).count() == 0
    kept = trie_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {1, 4, 7, None} <= {r.doc_id for r in kept.collect()}
    assert trie_join.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("slice_rows", [5, 4096])
def test_close_links_find_all_pairs(spark, slice_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    bits = {int(b) for b in base} | {0, -1, 1, -(1 << 63)}
    for _ in range(400):
        x = int(rng.choice(base)) & (1 << 64) - 1
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(bit)
        bits.add(x - (1 << 64) if x >> 63 else x)
    bits = sorted(bits)
    linked = [(a, b) for k, a in enumerate(bits) for b in bits[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    edges = trie_join.close_links(spark.createDataFrame([(b,) for b in bits], "fp long"), slice_rows=slice_rows).collect()
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 64 for r in edges)
    assert components(bits, [(r.u, r.v) for r in edges]) == components(bits, linked)


# Sharding.

def test_shards(spark, texts):
    rows = shuffle_shards.op2(spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
        assert r.grown_shard in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_shards_odd_rows(docs, none, tmp_path):
    written = shuffle_shards.write_shards(docs, str(tmp_path / "a"), 3, bucket_bytes=1000)
    rows = written.rows().select("shard", "_bucket", "_rank", "row.*").toDF("s", "b", "k", *docs.columns).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(i), str(t)) for i, t, _ in ROWS)
    assert len({r.s for r in rows if r.doc_id is None}) == 1
    again = shuffle_shards.write_shards(docs, str(tmp_path / "b"), 3, bucket_bytes=1000).rows().select("shard", "_bucket", "_rank", "row.doc_id").collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in written.rows().select("shard", "_bucket", "_rank", "row.doc_id").collect())
    empty = shuffle_shards.write_shards(none, str(tmp_path / "c"), 3)
    assert empty.rows().count() == 0 and empty.manifest().count() == 0


# Lines.

def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def altered(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.integers(0, len(out) + 1), rng.integers(0, 3)
        if kind == 0 or at == len(out):
            out.insert(at, rng.choice(list("aé😀 ")))
        elif kind == 1:
            out.pop(at)
        else:
            out[at] = rng.choice(list("aé😀 "))
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_join(spark, edits):
    rng = np.random.default_rng(edits)
    base = ["".join(rng.choice(list("abcdefg é"), rng.integers(14, 50))) for _ in range(30)]
    lines = sorted({altered(rng, base[rng.integers(30)], rng.integers(0, 5)) for _ in range(250)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    want = {(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if min(len(a), len(b)) >= 16 and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    known = edit_lines.distinct_lines(df, "doc_id", "text")
    text = {r.lid: r.line for r in known.collect()}
    assert {tuple(sorted((text[r.u], text[r.v]))) for r in edit_lines.line_links(known, edits).collect()} == want
    pairs = spark.createDataFrame([(a, b, distance(a, b)) for a in lines[:60] for b in lines[:60] if abs(len(a) - len(b)) <= edits] + [("", "", 0), ("", "a", 1)], "a string, b string, d int")
    got = pairs.select("d", edit_lines.banded_distance(F.col("a"), F.col("b"), edits).alias("e")).collect()
    assert all(r.e == r.d if r.d <= edits else r.e > edits for r in got)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_long_lines_are_joined(spark, edits):
    rng = np.random.default_rng(40 + edits)
    base = ["".join(rng.choice(list("abcdefg é"), n)) for n in (94, 95, 96, 97, 98, 130, 300)]
    lines = sorted({altered(rng, base[rng.integers(len(base))], rng.integers(0, 5)) for _ in range(250)})
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    known = edit_lines.distinct_lines(df, "doc_id", "text")
    text = {r.lid: r.line for r in known.collect()}
    want = {(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits}
    assert {tuple(sorted((text[r.u], text[r.v]))) for r in edit_lines.line_links(known, edits, 0).collect()} == want


def test_near_copies_meet_where_windows_agree(spark):
    rng = np.random.default_rng(60)
    base = "".join(rng.choice(list("abcdefgh é"), 140))
    lines = {base[:at] + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) + base[at:] for at in rng.integers(0, 140, 50)}
    lines = sorted(lines | {altered(rng, line, 2) for line in sorted(lines)[:20]})
    known = edit_lines.distinct_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text")
    text = {r.lid: r.line for r in known.collect()}
    found = [tuple(sorted((text[r.u], text[r.v]))) for r in edit_lines.line_links(known, 2).collect()]
    odd = [sum((line.count(c) % 2) << n for n, c in enumerate(edit_lines.LETTERS)) for line in lines]
    near = [(a, b) for k, a in enumerate(lines) for n, b in enumerate(lines[k + 1 :], k + 1) if bin(odd[k] ^ odd[n]).count("1") <= 4]
    want = {(a, b) for a, b in near if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2}
    assert set(found) == want and len(found) == len(want)
    # By letters of whole lines alone, most near misses would meet.
    assert edit_lines.meeting_pairs(known, 2).count() - len(want) < (len(near) - len(want)) / 4


def test_code_of_line_keys_is_compiled(spark, docs, capsys):
    known = edit_lines.distinct_lines(docs, "doc_id", "text")
    for keys in edit_lines.meeting_keys(known, 2):
        keys.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) >= 2 and max(sizes) < 8000  # the JVM interprets larger methods


def test_line_classes_odd_rows(spark, docs, none):
    same, near = "the quick brown fox jumps", "the quick brown fax jumps"
    df = spark.createDataFrame([(2, f"{same}\nx\n{same}"), (1, f"{near}\n\nx"), (None, "only here, twice over\n" + same), (5, None), (6, "")], "doc_id long, text string")
    found = {(r.doc, r["at"]): r for r in edit_lines.line_classes(df).collect()}
    assert (found[2, 0].copies, found[2, 0].n_links, found[2, 0].class_doc, found[2, 0].kept) == (3, 1, 1, False)
    assert found[1, 0].kept and found[1, 2].copies == 2 and found[1, 1].copies == 2 and not found[None, None].kept
    clean = {r.doc_id: r.text for r in edit_lines.without_repeated_lines(df, least=16).collect()}
    assert clean == {1: f"{near}\n\nx", 2: "", None: "only here, twice over\n" + same, 5: None, 6: ""}
    assert edit_lines.line_classes(none).count() == 0
    assert edit_lines.line_classes(docs).agg(F.sum("copies")).first()[0] == sum(len(t.split("\n")) for _, t, _ in ROWS if t is not None)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_short_lines_are_joined(spark, edits):
    rng = np.random.default_rng(20 + edits)
    lines = sorted({"".join(rng.choice(list("abcé"), rng.integers(0, 11))) for _ in range(300)} | {"", "a", "Atonor a it.", "Anor a it."})
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    known = edit_lines.distinct_lines(df, "doc_id", "text")
    text = {r.lid: r.line for r in known.collect()}
    want = {(a, b) for k, a in enumerate(lines) for b in lines[k + 1 :] if distance(a, b) <= edits}
    found = [tuple(sorted((text[r.u], text[r.v]))) for r in edit_lines.line_links(known, edits, 0).collect()]
    assert set(found) == want and len(found) == len(want)


def test_every_line_row_names_its_class(spark, none):
    rows = [(1, "the first line of all\nshort\nthe first line of all"), (2, "shirt\nthe first lime of all\nalone here, nothing like it"), (3, "the first line of all"), (None, "short"), (4, None), (5, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc or 0, r["at"], r.copies, r.n_links, r.class_doc, r.class_at, r.kept) for r in edit_lines.line_members(df).collect())
    assert found == [
        (0, 0, 2, 1, 1, 1, False), (1, 0, 3, 1, 1, 0, True), (1, 1, 2, 1, 1, 1, True), (1, 2, 3, 1, 1, 0, False), (2, 0, 1, 1, 1, 1, False),
        (2, 1, 1, 1, 1, 0, False), (2, 2, 1, 0, 2, 2, True), (3, 0, 3, 1, 1, 0, False), (5, 0, 1, 0, 5, 0, True),
    ]
    assert edit_lines.line_members(none).count() == 0


def test_line_query_has_every_line_row(spark, texts):
    want = sorted((i, k) for i, t in texts for k in range(len(t.split("\n"))))
    assert sorted((r.doc_id, r.line_no) for r in edit_lines.op3(spark, SF).collect()) == want


# Byte-level BPE.

@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.Encoder(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_on_documents(spark, both, texts):
    found = {r.doc_id: r for r in bpe.op5(spark, SF).collect()}
    for i, text in texts:
        ids = np.array(both[1].encode_ordinary(text), "<u4")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_trees(both, monkeypatch):
    own, public = both
    own.match_ids.clear()
    monkeypatch.setattr(bpe, "LEAF_CHARS", 5)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 3)
    rng = np.random.default_rng(0)
    parts = [" ", "\n", "\t", "'", "s", "re", "ll", "a", "aa", "Z", "9", "é", "ß", "!", " ", "　", "漢", "😀", "'s", "it's", "  ", "The", "²"]
    for k in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 60)))
        text = "".join(rng.choice(list("abeinrst"), 90)) if k % 5 == 0 else str(rng.choice(["a", "ab", " ", "=", "é"])) * int(rng.integers(0, 200)) if k % 7 == 0 else text
        assert own.encode(text) == public.encode_ordinary(text), text
        assert own.decode(own.encode(text)) == text.encode()
    assert own.encode(None) == own.encode("") == []


# Packing.

def test_pack_fits_and_downsizes():
    rng = np.random.default_rng(2)
    lengths = best_fit.Lengths((16, 32, 64))
    pieces = rng.integers(0, 65, 500).tolist()
    bins, start, sizes = best_fit.pack(pieces, lengths)
    spans = defaultdict(list)
    for n, b, s in zip(pieces, bins, start):
        spans[b].append((s, s + n))
    for b, inside in spans.items():
        inside.sort()
        assert inside[0][0] == 0 and all(x[1] == y[0] for x, y in zip(inside, inside[1:]))
        assert sizes[b] == min(c for c in lengths.sizes if c >= inside[-1][1])
    assert sum(sizes) < 1.1 * sum(pieces) and best_fit.pack([], lengths) == ([], [], [])


def test_pack_chooses_the_best_open_bin():
    lengths = best_fit.Lengths((10,), fixed=1)
    assert best_fit.pack([7, 6, 4, 3], lengths) == ([0, 1, 1, 0], [0, 0, 6, 7], [10, 10])


def test_pack_rows(spark, docs, none):
    rows = best_fit.pack_rows(docs, best_fit.word_count(F.col("text")), group_pieces=6).collect()
    pieces = defaultdict(int)
    for r in rows:
        pieces[r.id] += r.length
        assert 0 <= r.start and r.start + r.length <= r.capacity
    want = defaultdict(int)
    for i, t, _ in ROWS:
        want[i] += len((t or "").split())
    assert pieces == want and len(rows) == len(ROWS) + 3 * (-(-30_000 // 2048) - 1)
    assert best_fit.pack_rows(none, F.lit(1)).count() == 0


# Secrets.

def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer("""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(1)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(found)


def test_base_secrets():
    rng = np.random.default_rng(4)
    parts = ["token", "=", ": ", "secret", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "Password", '"', " ", "é", "api_key", "apikey", "abcdefghijkl", "ſecret", "K"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert entropy_scan.Scanner().base(text) == brute_base(text), text


def test_entropy_windows_match_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(300):
        run = "".join(rng.choice(list("abcdef0123456789"), rng.integers(1, 60)))
        hot = [False] * len(run)
        for i in range(len(run) - 19):
            part = run[i : i + 20]
            share = np.array([part.count(c) for c in set(part)]) / 20
            if -(share * np.log2(share)).sum() >= 3.2 - 1e-9:
                hot[i : i + 20] = [True] * 20
        told = [False] * len(run)
        for a, b in entropy_scan.hot_windows(run, 20, 3.2):
            told[a:b] = [True] * (b - a)
        assert told == hot


def test_entropy_adds_and_allow_list_suppresses():
    secret = "q7Rz2mX9vB4kT1wY8pL3"
    base, added = entropy_scan.Scanner()(f"é {secret} end")
    assert base == [] and added == [(2, 3, 22)]
    for harmless in ("Donaudampfschifffahrtsgesellschaftskapitaen", "123e4567-e89b-12d3-a456-426614174000", "some/long/path/to/a/file2", "ABCDEFGHIJ0123456789",
                     "/Watch/Best-Movies-2023-In-Theaters", "/wiki/History_of_Europe_1945", "/Users/John/Documents/Report_Final_2024_v2",
                     "/2024/03/15/technology/openai-microsoft-google", "/products/AirPods-Pro-2/reviews", "0123456789" * 9):
        assert entropy_scan.Scanner()(harmless)[1] == [], harmless


def test_a_counting_part_hides_no_key():
    key = "q7Rz2mX9vB4kT1wY8pL3"
    assert entropy_scan.Scanner()(f"0123456789{key}abcdefghij")[1] == [(10, 3, 30)]


def test_spans_are_swept_once():
    """Spans inside others are told once, however many keys a text holds."""
    rng = np.random.default_rng(15)
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 300, 200), rng.integers(1, 40, 200))]
    spans, covers = sorted(set(spans[:150])), spans[150:]
    want = [x for x in spans if not any(s <= x[0] and x[1] <= e for s, e in covers) and not any(y[0] <= x[0] and x[1] <= y[1] and y != x for y in spans)]
    assert entropy_scan.uncovered(spans, covers) == want
    keys = ["".join(rng.choice(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), 24)) for _ in range(20_000)]
    start = time.time()
    assert len(entropy_scan.Scanner()(" ".join(keys))[1]) > 19_000 and time.time() - start < 20


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", "0123456789abcdefABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/"])
def test_random_keys_of_every_alphabet_are_found(alphabet):
    rng = np.random.default_rng(13)
    for size in (20, 32, 40, 64):
        keys = ["".join(rng.choice(list(alphabet), size)) for _ in range(300)]
        assert np.mean([any(s <= 4 and e >= 4 + size // 2 for s, _, e in sum(entropy_scan.Scanner()(f"see {k} end"), [])) for k in keys]) > 0.95, size
    assert entropy_scan.Scanner()("123E4567-E89B-12D3-A456-426614174000")[1] == []


def test_secret_columns(docs, none):
    found = {r.doc_id: r.s for r in docs.select("doc_id", entropy_scan.secret_spans(F.col("text")).alias("s")).collect()}
    assert [tuple(x) for x in found[-11]] == [("assign", 0, 24)] and found[5] == found[4] == []
    clean = entropy_scan.redact(docs)
    assert clean.columns == docs.columns and {r.doc_id: r.text for r in clean.collect()}[-11] == "[secret]"
    assert entropy_scan.redact(none).count() == 0


def test_secret_query(spark, texts):
    from quern.llm.entropy_scan import op7

    found = {r.doc_id: r for r in op7(spark, SF).collect()}
    for i, text in texts:
        base = brute_base(text)
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        kinds = ("assign", "access", "hex")
        base = brute_base(text or "")
        assert found[i].base_sha256 == hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


# Classifiers.

def labels(spark):
    return spark.createDataFrame([(i, int(i % 2), int(i % 2)) for i in range(400)] + [(None, 1, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")


def labelled(spark):
    rng = np.random.default_rng(6)
    words = ["river", "stone", "green", "walk", "tree", "paper", "music", "house"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, rng.integers(20, 80)))
        rows.append((i, text + ". " if i % 2 else text.upper().replace(" ", " ### ")))
    return rows


def test_quality(spark, docs, none):
    df = spark.createDataFrame([*labelled(spark), (None, None), (500, ""), (501, None)], "doc_id long, text string")
    rows = quadratic_quality.quality_scores(df, labels(spark)).collect()
    by = {r.id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and len(rows) == 403
    assert all(r.held_out == (r.id is not None and zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.id < 400]
    assert len(held) > 80 and np.mean([r.predicted == r.id % 2 for r in held]) > 0.97 and by[500].score == by[501].score
    kept = {r.doc_id for r in quadratic_quality.drop_low_quality(df, labels(spark)).collect()}
    assert {i for i in range(400) if by[i].predicted} == {i for i in kept if i is not None and i < 400}
    assert quadratic_quality.quality_scores(none, labels(spark)).count() == 0
    assert {r.score for r in quadratic_quality.quality_scores(docs, labels(spark).limit(0)).collect()} == {0.5}


def test_quality_density_is_that_of_the_gaussians(spark, monkeypatch):
    rng = np.random.default_rng(8)
    d = len(quadratic_quality.STATISTICS)
    x = [rng.normal(size=(300, d)), rng.normal(1, 2, size=(500, d))]
    rows = [(k, v.tolist()) for k in (0, 1) for v in x[k]]
    monkeypatch.setattr(quadratic_quality, "GRID", ((0, 0),))
    model = quadratic_quality.fit(spark.createDataFrame(rows, "label int, statistics array<double>"))

    def logpdf(p, data):
        cov, diff = np.cov(data.T, bias=True), p - data.mean(axis=0)
        return -0.5 * (np.linalg.slogdet(cov)[1] + diff @ np.linalg.solve(cov, diff))

    for p in (x[0][0], x[1][0], np.zeros(d)):
        want = np.log(500 / 300) + logpdf(p, x[1]) - logpdf(p, x[0])
        assert model.scores(p[None])[0] == pytest.approx(1 / (1 + np.exp(-np.clip(want, -500, 500))), rel=1e-6, abs=1e-12)


def test_toxicity_learns_pairs(spark, docs, none):
    """Neither word alone is toxic, both together are: additive weights cannot tell."""
    rng = np.random.default_rng(9)
    rows, marks = [], []
    for i in range(1200):
        a, b = bool(rng.integers(2)), bool(rng.integers(2))
        rows.append((i, " ".join(["filler", "text"] + ["snarl"] * a + ["gnomes"] * b + [str(rng.choice(["oak", "elm", "ash"]))])))
        marks.append((i, int(a and b)))
    known = spark.createDataFrame(marks, "doc_id long, toxic int")
    df = spark.createDataFrame([*rows, (None, "snarl gnomes"), (5000, None), (5001, "")], "doc_id long, text string")
    found = {r.id: r for r in factor_toxicity.toxicity_scores(df, known).collect()}
    held = [(found[i].predicted, y) for i, y in marks if found[i].held_out]
    assert len(held) > 300 and np.mean([p == y for p, y in held]) > 0.98
    assert found[None].predicted == 1 and found[5000].score == found[5001].score < 0.7
    assert factor_toxicity.toxicity_scores(none, known).count() == 0
    assert {r.score for r in factor_toxicity.toxicity_scores(docs, known.limit(0)).collect()} == {0.0}


def test_machine_score_is_the_pairwise_sum():
    rng = np.random.default_rng(10)
    m = factor_toxicity.Machine({t: t for t in range(6)}, 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    terms = {0, 2, 5, 99}
    logit = 0.3 + sum(m.weights[i] for i in (0, 2, 5)) + sum(m.vectors[i] @ m.vectors[j] for i, j in ((0, 2), (0, 5), (2, 5)))
    assert m.score(terms) == pytest.approx(1 / (1 + np.exp(-logit)))


# Embeddings.

@pytest.mark.parametrize("window,block", [(48, 256), (4, 8)])
def test_projections(spark, window, block):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[rng.integers(12)] + rng.normal(0, 0.05, 16)).astype(np.float32).tolist() for _ in range(300)]
    rows = [(i, v, int(i % 2)) for i, v in enumerate(vectors)] + [(1000 + i, vectors[3], 1) for i in range(30)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, vectors[3], None), (2005, [1.0, 2.0], 1), (2006, [float("inf")] + [1.0] * 15, 1), (2007, [], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, cid int")
    found = {r.id: r for r in projections.near_vectors(df, window=window, block=block).collect()}
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    ids = [r[0] for r in rows]
    links = np.array([found[i].n_links for i in ids])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.95 * near.sum()
    root = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    assert {i: found[i].component_id for i in ids} == root and all(found[i].kept == (root[i] == i) for i in ids)
    assert all((found[i[0]].n_links, found[i[0]].component_id, found[i[0]].kept) == (0, i[0], True) for i in odd)
    assert projections.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [10, 64, 1000, 10_000, 200_000, 4_000_000, 10**9])
def test_passes_keep_the_recall_of_large_labels(rows):
    """Two vectors at the limit agree in a bit with probability 1 - angle / pi; equal strings are always compared."""
    same = (1 - np.arccos(0.93) / np.pi) ** projections.sign_bits(rows)
    assert 1 - (1 - same) ** projections.passes_for(rows) >= 0.99 and rows / 2 ** projections.sign_bits(rows) <= 64


def test_dense_label_beside_a_small_one(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=32) + rng.normal(0, 0.25, (2500, 32))
    label = np.where(np.arange(2500) < 2400, 1, 2)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    links = {r.id: r.n_links for r in projections.near_vectors(df).collect()}
    found = np.array([links[i] for i in range(2500)])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.99 * near.sum() and (found[2400:] == near.sum(axis=1)[2400:]).all()


# The pipeline, each stage on the rows that it gets.

def test_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} >= set(range(1, 11)) and "pipeline" in queries()
    assert "pipeline" not in oracle_sql() and [n for n, _ in pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, known = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    out = []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert name == "packing" or made.columns == columns
        docs = pipeline.stored(made, name)
        out.append(docs.collect())
    good, exact, near, clean, packed = out
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in good} == {r.id for r in quadratic_quality.quality_scores(first, known).collect() if r.predicted}
    least = {}
    for r in good:
        key = re.sub("[\x20\x09-\x0d]+", " ", r.text)
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    assert {r.doc_id for r in exact} == set(least.values())
    prints = {r.doc_id: brute_fingerprint(r.text) for r in exact}
    ids = sorted(prints)
    root = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r.doc_id for r in near} == set(root.values())
    texts = {r.doc_id: r.text for r in near}
    scan = entropy_scan.Scanner()
    for r in clean:
        base, added = scan(texts[r.doc_id])
        assert (r.text == texts[r.doc_id]) == (not base + added) and not scan.base(r.text) and r.n_chars == len(r.text)
    assert {r.doc_id for r in clean} == set(texts)
    words = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in clean}
    total = dict.fromkeys(words, 0)
    for r in packed:
        total[r.doc_id] += r.length
    assert total == words


def test_near_stage_odd_rows(spark, docs, none):
    kept = pipeline.near(spark, docs, SF)
    assert kept.columns == docs.columns and pipeline.near(spark, none, SF).count() == 0
    prints = [brute_fingerprint(t) for _, t, _ in ROWS]
    root = components(range(len(ROWS)), [(a, b) for a in range(len(ROWS)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(ROWS):
        least[root[k]] += [i] if i is not None else []
    stay = {min(ids) for ids in least.values() if ids}
    found = [r.doc_id for r in kept.collect()]
    # Rows that repeat an id share its fate, those without one stay.
    assert sorted(i for i in found if i is not None) == sorted(i for i, _, _ in ROWS if i in stay) and found.count(None) == 2


def test_secrets_stage_odd_rows(spark, docs, none):
    odd = docs.withColumn("_before", F.lit("mine")).drop("n_chars")
    clean = {(r.doc_id, r.part): r for r in pipeline.secrets(spark, odd, SF).collect()}
    assert len(clean) == len({(i, p) for i, _, p in ROWS}) and {r._before for r in clean.values()} == {"mine"}
    assert clean[-11, 0].text == "[secret]" and clean[5, 1].text is None and clean[4, 1].text == "" and clean[7, 5].text == LONG
    assert pipeline.secrets(spark, none, SF).columns == none.columns and pipeline.secrets(spark, none, SF).count() == 0


def test_run_leaves_only_its_rows(spark):
    """Two runs give the same rows, and the first one's are still there."""
    before = set(os.listdir(shared_folder(spark)))
    first = pipeline.run(spark, SF)
    made = {n for n in set(os.listdir(shared_folder(spark))) - before if "-" in n and not n.count("-") == 4}
    second = pipeline.run(spark, SF)
    assert first.exceptAll(second).count() == second.exceptAll(first).count() == 0
    assert len(made) == 1 and next(iter(made)).startswith("packing")
