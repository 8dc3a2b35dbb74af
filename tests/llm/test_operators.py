"""Each operator against brute force or a round trip, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import collections
import hashlib
import io
import itertools
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import connect, same_rows  # noqa: E402

from tidewell.llm import lm, mixing, near_dups, pieces, pii, quality, registry, substrings, toxicity, vectors, warc  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: doc_id and text, with columns whose names clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, copy_no int, h long, rep long, score double, id string"


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base, passage = [sentence(rng, 120) for _ in range(12)], sentence(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    near = base[3].split()
    near[60] = "changed"
    rows += [(20, base[3]), (21, " ".join(near)), (22, base[3]), (23, f"{sentence(rng, 40)} {passage} {sentence(rng, 30)}"), (24, f"{sentence(rng, 10)}\n{passage}"), (25, passage)]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "one two three four"), (35, "é😀 ünï a@b.cc +49 123 456 789 10.0.0.1")]
    rows += [(36, "same words again " * 4000), (37, "x" * 50_000), (38, "line here\n" * 9 + "other line"), (39, sentence(rng, 19)), (40, sentence(rng, 20))]
    rows += [(1, base[1]), (None, base[2])]  # a repeated row, a row without id
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 5 else None, len(t or ""), True, 7, 1, 2, 0.5, "z") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name])


# 1 ---------------------------------------------------------------------------------------------


def brute_quality(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), []
    for x in lines:
        (dup.append(x) if x in seen else seen.add(x))
    out = {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(dup), "dup_line_chars": sum(map(len, dup)), "n_lines": len(lines), "line_chars": sum(map(len, lines))}
    for n in {*quality.NGRAM_LIMITS, 8}:
        first, later, every = {}, set(), set()
        for i in range(len(ws) - n + 1):
            g = tuple(ws[i : i + n])
            if g in first:
                later |= set(range(i, i + n))
                every |= set(range(i, i + n)) | set(range(first[g], first[g] + n))
            first.setdefault(g, i)
        if n in quality.NGRAM_LIMITS:
            out[f"dup_chars_{n}"] = sum(len(ws[i]) for i in later)
        if n == 8:
            out["n_repeat_words"] = len(every)
    return out


def test_quality(spark, docs, texts, nothing):
    got = collections.Counter((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in quality.quality_rules(docs).collect())
    assert got == collections.Counter((i, *(brute_quality(t)[c] for c in quality.COUNTS)) for i, t in texts)
    flags = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_rules(docs).collect()}
    assert flags[30] == flags[39] == flags[36] == (True, False) and flags[40] == (False, True) and flags[0] == (False, True)
    kept = quality.quality_rules(docs, carry=True)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, f in flags.items() if f[1]}
    assert quality.quality_rules(nothing).count() == 0


# 2 ---------------------------------------------------------------------------------------------


def brute_substrings(rows):
    rows = [(i, words(t)) for i, t in rows if i is not None]
    first = {}
    for i, ws in rows:
        for k in range(len(ws) - 49):
            w = tuple(ws[k : k + 50])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in rows:
        gone = {j for k in range(len(ws) - 49) if first[tuple(ws[k : k + 50])] < i for j in range(k, k + 50)}
        out.append((i, len(ws), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(ws) if j not in gone).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [2000, 0])
def test_substrings(spark, docs, texts, nothing, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SEGMENTS", hot)
    got = substrings.remove_repeated(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None) == brute_substrings(texts)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert substrings.remove_repeated(nothing).count() == 0


def test_fm_index_statistics():
    rng = random.Random(5)
    for _ in range(40):
        base = [rng.randrange(5) for _ in range(260)]
        rows = []
        for d in range(rng.randint(1, 9)):
            a = rng.randrange(150)
            x = base[a : a + rng.randint(50, 105)]
            if rng.random() < 0.6:
                x[rng.randrange(len(x))] = 9
            rows.append((d, a, x))
        got = {(int(i), int(s)) for i, a, b in zip(*substrings.shard_ranges(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [np.array(r[2], np.uint64).tobytes() for r in rows]), strict=True) for s in range(a, b + 1)}
        want = {(d, f + s) for d, f, x in rows for s in range(len(x) - 49) if any(e < d and any(y[k : k + 50] == x[s : s + 50] for k in range(len(y) - 49)) for e, _, y in rows)}
        assert got == want


def test_wavelet_rank():
    s = np.random.default_rng(1).integers(0, 37, 500)
    tree = substrings.WaveletTree(s, 37)
    c, i = np.random.default_rng(2).integers(0, 37, 300), np.random.default_rng(3).integers(0, 501, 300)
    assert tree.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i, strict=True)]


# 3 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(registry.tokenizer_path("piece_bpe_32k.model"))


def test_pieces(spark, docs, texts, nothing, codec):
    got = collections.defaultdict(list)
    for r in pieces.encode_documents(docs, registry.tokenizer_path("piece_bpe_32k.model")).collect():
        got[r.doc_id].append(r)
    for i, t in texts:
        r, raw = got[i][0], (t or "").encode()
        assert r.ids == codec.lib.encode(t or "", add_eos=True) and r.decoded == codec.lib.decode(r.ids)
        assert b"".join(raw[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == raw and r.ends[-1] == len(raw)
    assert pieces.encode_documents(nothing, registry.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_pieces_query_digests_the_spans(spark, docs, texts, codec, monkeypatch):
    """The spans of the query are those of the surfaces that the library reports."""
    monkeypatch.setattr(registry, "table", lambda *_: docs)
    rows = {r.doc_id: r for r in registry.op3_sentencepiece(spark, "").collect()}
    for i, t in texts:
        ends, at = [], 0
        begins = []
        for p in codec.lib.encode(t or "", return_type="proto").pieces:
            begins.append(at)
            at += len(p.surface.encode())
            ends.append(at)
        size = len((t or "").encode())
        spans = " ".join(map(str, [*begins, size, *ends, size]))
        assert at == size and rows[i].n_bytes == size and rows[i].spans_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def darts(entries):
    """A double array (label | leaf | offset units) of a few keys, and the blob around it."""
    strings, places = b"", {}
    for k, v in entries.items():
        places[k.encode()] = len(strings)
        strings += v.encode() + b"\0"
    units, used, base = {0: 0}, {0}, 1

    def place(prefix, node):
        nonlocal base
        kids = sorted({k[len(prefix)] for k in places if len(k) > len(prefix) and k.startswith(prefix)})
        leaf = prefix in places
        while True:  # an offset at which all children are free
            slots = [(node ^ base) ^ c for c in kids] + ([node ^ base] if leaf else [])
            if base < 1 << 20 and not any(s in used for s in slots) and len(set(slots)) == len(slots) and (node ^ base) not in used:
                break
            base += 1
        own = base
        used.update([*slots, node ^ own])
        units[node] |= own << 10 | (leaf << 8)
        if leaf:
            units[node ^ own] = 1 << 31 | places[prefix]
        for c in kids:
            units[(node ^ own) ^ c] = c
        base += 1
        for c in kids:
            place(prefix + bytes([c]), (node ^ own) ^ c)

    place(b"", 0)
    trie = b"".join(units.get(i, 0xFF).to_bytes(4, "little") for i in range(max(units) + 300))
    return len(trie).to_bytes(4, "little") + trie + strings


def test_character_map_takes_longest_prefixes(codec):
    table = {"ﬁ": "fi", "a": "A", "ab": "X", "\t": " "}
    m = pieces.CharsMap(darts(table))
    for text in ("ab", "ac", "ﬁx", "zz", "a", "\t"):
        data = text.encode()
        want = max((k for k in table if text.startswith(k)), key=len, default=None)
        assert m.longest(data, 0) == (None if want is None else (len(want.encode()), table[want].encode()))
    c = pieces.PieceCodec.__new__(pieces.PieceCodec)
    c.map, c.prefix, c.squeeze, c.escape = m, True, True, True
    out, source = c.normalise("  ﬁ\t ab ".encode())
    assert out.decode() == "▁fi▁X" and source.tolist() == [2, 2, 2, 2, 2, 5, 5, 5, 7, 9]


# 4 ---------------------------------------------------------------------------------------------


def brute_classes(rows):
    rows = [(i, words(t)) for i, t in rows if i is not None]
    shingles = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([("short", *w)]) for i, w in rows}
    parent = {i: i for i in shingles}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(shingles, 2):
        both = len(shingles[a] & shingles[b])
        if both / (len(shingles[a]) + len(shingles[b]) - both) >= 0.8:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {i: find(i) for i in shingles}


def test_near_duplicates(spark, docs, texts, nothing):
    got = near_dups.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == brute_classes(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got) and len(got) == len(texts)
    one = near_dups.one_of_each(docs)
    assert one.schema == docs.schema
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == sorted({c for c in brute_classes(texts).values()})
    assert near_dups.near_duplicates(nothing).count() == 0


def test_a_centre_that_is_far_hides_no_link(spark):
    """Documents that share sketches with a far smaller one still meet each other."""
    rng = random.Random(3)
    base = sentence(rng, 300).split()
    rows = [(0, " ".join(base[:150] + sentence(rng, 150).split()))]
    for i in range(1, 8):
        w = list(base)
        w[rng.randrange(300)] = "edit"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(df).collect()} == brute_classes(rows)


def test_short_near_copies_meet(spark):
    """Near copies of 8 to 60 words: a word added or changed at either end, two words added."""
    rng = random.Random(5)
    rows = []
    for n in [*range(8, 21), 12, 12, 12, 12, 25, 34, 43, 44, 52, 53, 60]:
        w = sentence(rng, n).split()
        for v in (w, [*w, "end"], ["start", *w], [*w, "two", "more"], [*w[:-1], "last"]):
            rows.append((len(rows), " ".join(v)))
    common = sentence(rng, 9)
    rows += [(len(rows) + i, f"{common} {sentence(rng, 1 + i % 3)}") for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dups.near_duplicates(df).collect()} == brute_classes(rows)


@pytest.mark.parametrize("block", [near_dups.BLOCK_RUNS, 700])
def test_groups_of_several_blocks_lose_no_link(spark, block, monkeypatch):
    """Near copies around one text, some of them only near to each other, in one block and in many; rows are repeated."""
    monkeypatch.setattr(near_dups, "BLOCK_RUNS", block)
    rng = random.Random(8)
    base, rows = sentence(rng, 120).split(), []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(0, 120, 6), i % 8):
            w[at] = f"e{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            rows.append((100 + i, " ".join([*w[:-1], "last"])))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dups.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows) and len(got) == len(rows)


def test_forest_joins_what_links_join():
    rng = random.Random(9)
    sets = []
    for _ in range(12):
        base = rng.sample(range(1000, 9000), 60)
        sets += [[k for k in base if rng.random() > 0.04] + rng.sample(range(9000, 99999), rng.randrange(8)) for _ in range(rng.randrange(1, 9))]
    comp = [rng.randrange(len(sets)) for _ in sets]
    keys, bounds = np.concatenate([np.array(x, np.uint64) for x in sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets])])

    def classes(pairs):
        label = list(comp)
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if near_dups.aligned(*(np.array(sets[i], np.uint64) for i in (a, b))) >= 0.8]
    found = near_dups.forest(np.array(comp), keys, bounds)
    assert classes(found) == classes(links) and len(found) < len(set(comp)) and len(links) > 20


def test_sketches_hold_the_least_runs_in_text_order(monkeypatch):
    rng = np.random.default_rng(4)
    bounds = np.concatenate([[0], np.cumsum(rng.integers(1, 300, 60))])
    keys = rng.integers(0, 1 << 63, bounds[-1], dtype=np.uint64)

    def brute(k, seed):
        least, value = np.sort(np.argsort(near_dups.mix(k ^ seed))[: near_dups.PICKS]), seed
        for x in k[least]:
            value = near_dups.mix(np.array([value * near_dups.WORD_BASE + x]))[0]
        return value

    with np.errstate(over="ignore"):
        want = np.array([[brute(keys[a:b], seed) for seed in near_dups._SEEDS] for a, b in itertools.pairwise(bounds)])
    assert (near_dups.sketches(keys, bounds) == want).all()
    monkeypatch.setattr(near_dups, "DRAWN", 3)  # most draws are too few, and are made up
    assert (near_dups.sketches(keys, bounds) == want).all()


def test_rows_without_id_all_stay(spark):
    rows = [(1, "one text here"), (1, "one text here"), (None, "a first"), (None, "a second"), (None, "a second"), (2, "another")]
    one = near_dups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in one) == [(0, "a first"), (0, "a second"), (0, "a second"), (1, "one text here"), (2, "another")]


def test_own_names_of_the_input_stay(spark):
    """Columns that are named as an operator would name its own come back as they were."""
    rows = [(1, "one text here", 5, "a", 2.5, 6, "b", 7), (2, "one text here", 8, "c", 1.5, 9, "d", 1), (None, None, 1, "e", 0.5, 2, "f", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, _gone string, mix_rate double, mix_key int, source string, kept int")
    assert sorted(map(tuple, near_dups.one_of_each(df).collect()), key=str) == sorted([rows[0], rows[2]], key=str)
    mixed = mixing.mix_sources(df, size=3.0)
    assert mixed.columns == [*df.columns, "copy_no"] and {tuple(r)[:-1] for r in mixed.collect()} <= set(rows)


def test_alignment_respects_order():
    a = np.arange(100, dtype=np.uint64)
    assert near_dups.aligned(a, a) == 1.0
    moved = np.concatenate([a[50:], a[:50]])
    assert near_dups.aligned(a, moved) == pytest.approx(50 / 150)


# 5 ---------------------------------------------------------------------------------------------


def test_mixing(spark, docs, texts, nothing):
    weights = {"s0": 3.0, "s1": 1.0, "s2": 0.0}
    got = mixing.mix_sources(docs, weights=weights, size=40.0).collect()
    counts = collections.Counter(r.source for r in got)
    assert counts["s2"] == 0 and counts["s0"] / counts["s1"] == pytest.approx(3, rel=0.25) and None not in counts
    per = collections.Counter((r.doc_id, r.copy_no) for r in got)
    assert all(n == (2 if i == 1 else 1) for (i, _), n in per.items())  # equal rows draw equal counts
    again = mixing.mix_sources(docs.repartition(7), weights=weights, size=40.0).collect()
    assert collections.Counter(map(str, again)) == collections.Counter(map(str, got))
    assert mixing.mix_sources(nothing).count() == 0


def test_poisson_inversion(spark):
    df = spark.range(20000).withColumn("k", mixing.poisson(mixing.uniform("id"), F.lit(2.5)))
    mean, var = df.agg(F.avg("k"), F.variance("k")).first()
    assert mean == pytest.approx(2.5, abs=0.05) and var == pytest.approx(2.5, abs=0.12)


# 6 ---------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(8)
    terms = ["worthless", "trash", "loser", "pathetic"]
    m = toxicity.Model(terms, np.ones(4))
    tried = []
    for t in terms * 60:
        w = list(t)
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "ß", "t"])
        tried.append("".join(w) or "x")
    _, word, _, errors, _, _ = m.hits([" ".join(tried)])
    got = dict(zip(word.tolist(), errors.tolist(), strict=True))
    for i, w in enumerate(tried):
        near = [edits(w, t) for t in terms if edits(w, t) <= (len(t) >= toxicity.FUZZY_LENGTH)]
        assert got.get(i) == min(near, default=None)


def test_toxicity_learns_and_generalises(spark, docs, nothing):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(300):
        w, bad = sentence(rng, 60, 300).split(), i % 5 == 0
        if bad:
            w[30] = rng.choice(["scumbag", "worthless", "idiotic"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, l)
    got = {r.doc_id: r.score for r in toxicity.score_documents(d, model).collect()}
    right = sum((got[i] >= toxicity.CUT) == bool(y) for i, y in marks)
    assert right >= 295
    odd = spark.createDataFrame([(1, "a wortless thing"), (2, None), (3, ""), (4, "plain " * 9), (5, "x" * 100_000)], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score_documents(odd, model).collect()}
    assert s[1] > s[4] and s[2] == s[3] and all(0 <= x <= 1 for x in s.values())
    assert toxicity.score_documents(docs, model).count() == docs.count()
    blank = toxicity.train(nothing, l.where("false"))
    assert toxicity.score_documents(nothing, blank).count() == 0


# 7 ---------------------------------------------------------------------------------------------


def test_warc(spark, nothing):
    big, rows = "<p>é</p>" * 30, []
    rows = [(5, "http://a/\r\nx", big, 1), (2, None, big, 1), (9, "u", big, 1), (7, "u", "small", 1), (8, "u", "small", 1), (3, "u", None, 1), (4, "u", "", 1), (2, None, big, 1), (None, "u", big, 1), (10, "u", "\0" * 300_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = warc.archive_pages(df).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        revisit = h == big and i != 2
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc.archive_pages(df.where("false")).count() == 0


def test_archives_are_checked():
    records = [warc.record_bytes(i, "u", f"page {i} ".encode() * 40, hashlib.sha256(f"page {i} ".encode() * 40).hexdigest(), None) for i in range(40)]
    whole = warc.archive_bytes(records)
    assert int.from_bytes(whole[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.frames(io.BytesIO(whole))) == records
    assert [warc.parse_record(r)["page_id"] for r in records] == list(range(40))
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(io.BytesIO(whole[:-3])))
    for bad in (records[0].replace(b"WARC/1.1", b"WARP/1.1"), records[0][:-1], records[0].replace(b"page 0", b"page 1"), records[0].replace(b"Content-Length", b"Content Length", 1).replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)


# 8 ---------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_pii(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(out))


ODD = ["a@b.c%x@d.e f", "1.2.3.4.5.6.7.8 001.02.255.256 0000255.1.1.1", "4111 1111-1111 1111 4111-1111-1111-1111x4111111111111111", " +1 (213) 555-5044 +49 123", "é😀 x@y.zz +12345678901", "", None, "9" * 5000, "a" * 3000 + "@b.com", "+1+2 345 678 901", "a@b.c@d.e", "1..2.3.4.5", "5 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]


def test_pii_base_spans(spark, docs, texts):
    rng = random.Random(4)
    fuzz = ["".join(rng.choice("0123456789.+ -()@ab") for _ in range(rng.randrange(60))) for _ in range(400)]
    every = [*ODD, *fuzz]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    model = pii.Trees(0.0, [], math.inf)
    for r in pii.find_spans(df, model).select("doc_id", pii.joined("base").alias("b")).collect():
        assert r.b == brute_pii(every[r.doc_id]), every[r.doc_id]
    assert pii.find_spans(docs, model).count() == len(texts)


def test_pii_adds_and_redacts(spark, nothing):
    rng = random.Random(9)
    rows = [(i, f"{sentence(rng, 8)} call +1 ({200 + i % 700}) 555-{1000 + i} or m{i}@x.org token = \"{'%040x' % rng.getrandbits(160)}\" {sentence(rng, 3)} {i}.5 and 12-{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    assert model.trees and model.cut < math.inf
    got = pii.find_spans(df, model).select("base", "spans", "_text").collect()
    for r in got:
        assert all(b in r.spans for b in r.base) and any(pii.KINDS[x.k] == "secret" for x in r.spans)
        assert all(x.e <= y.s or x in r.base or y in r.base for x, y in zip(r.spans[:-1], r.spans[1:], strict=True))
    clean = spark.createDataFrame([(1, "write to a@b.org now", 5), (2, None, 6), (3, "nothing", 7)], "doc_id long, text string, base int")
    out = {r.doc_id: (r.text, r.base) for r in pii.redact(clean, model).collect()}
    assert out == {1: ("write to [EMAIL] now", 5), 2: (None, 6), 3: ("nothing", 7)}
    assert pii.train(nothing).cut == math.inf and pii.redact(nothing).count() == 0


def test_pii_in_a_text_of_many_matches(spark):
    """Texts of several chunks with characters of one to four bytes, hundreds of matches of all kinds, and many generated candidates."""
    rng = random.Random(12)
    parts = ["é𝄞 " * 40, "host 10.0.{0}.7", "m{0}@b.org", "+1 (212) 555-{0}", "call 212 555 {0}", "token={0}abcdefABCDEF0123456789", "x" * 90]
    texts = [" ".join(rng.choice(parts).format(100 + i % 150) for i in range(n)) for n in (0, 1, 40, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.withColumn("base", pii.base_spans(F.col("text"))).select("doc_id", "base", pii.candidates(F.col("text"), F.col("base")).alias("c")).collect()
    for r in got:
        text, seen = texts[r.doc_id], 0
        for c in r.c:
            assert c.over == any(b.s < c.e and b.e > c.s for b in r.base)
            before = text[max(0, c.s - 24) : c.s]
            assert c.left == (0 if not before or before[-1].isspace() else 2 if before[-1].isascii() and before[-1].isalnum() else 1)
            assert c.context == 1 if before.endswith("token=") else c.context == 2 if before.endswith(("host ", "call ")) else c.context in (0, 2)
            seen += 1
        assert bool(seen) == any(ch.isdigit() for ch in text)
    model = pii.Trees(0.0, [(("kind", 4), 1.0, (("context", 2), 1.0, -1.0))], 0.5)
    spans = {r.doc_id: r.spans for r in pii.find_spans(df, model).collect()}
    for r in pii.redact(df, model).collect():
        out, at = [], 0
        for x in spans[r.doc_id]:
            if x.e > at:
                out += [texts[r.doc_id][at : max(x.s, at)], f"[{pii.KINDS[x.k].upper()}]" if x.s >= at else ""]
                at = x.e
        assert r.text == "".join(out) + texts[r.doc_id][at:]


# 9 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16384, 7])
def test_vectors(spark, block):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 24))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(24) * 0.08 * (i % 4)], i % 2) for i in range(60)]
    rows += [(60, rows[0][1], 0), (61, rows[0][1], 0), (62, None, 0), (63, [0.0] * 24, 0), (64, [1.0, None] + [0.0] * 22, 0), (65, [float("nan")] + [1.0] * 23, 0), (66, rows[0][1], None), (67, [1.0], 0), (68, [2.0], 0), (69, [], 0), (70, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, near = collections.Counter(), collections.defaultdict(set)
    for (a, x, p), (b, y, q) in itertools.combinations(good, 2):
        if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links[a] += 1
            links[b] += 1
            near[a].add(b)
            near[b].add(a)
    want = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want[i] = (links[i], min(seen), min(seen) == i)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.vector_duplicates(df, block=block).collect()}
    assert got == want
    assert vectors.vector_duplicates(df.where("false")).count() == 0


def test_quantisation_bound_is_rigorous():
    x = vectors.Quantised(np.random.default_rng(1).standard_normal((200, 64)))
    exact = x.unit @ x.unit.T
    near = (x.q.astype(float) @ x.q.T.astype(float)) * x.scale[:, None] * x.scale[None]
    bound = x.rest[:, None] * x.length[None] + (x.length + x.rest)[:, None] * x.rest[None]
    assert (np.abs(exact - near) <= bound + vectors.SLACK).all() and bound.max() < 0.03


# 10 --------------------------------------------------------------------------------------------


def test_lm_base_and_score(spark, docs, texts, nothing, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    monkeypatch.setattr(lm, "STEPS", 20)
    path = registry.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    learn = F.col("doc_id") % 7 != 2
    got = lm.score_documents(docs, learn, path).collect()
    tokens = lambda t: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), 0]
    c = collections.Counter(w for i, t in texts if i is not None and i % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(nothing, learn, path).count() == 0


def test_lm_counts_the_subwords_of_all_training_documents(spark, monkeypatch):
    """Subwords that hardly any part holds still have the corpus's counts."""
    monkeypatch.setattr(lm, "STEPS", 0)
    path = registry.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    encoding = lm.encoder(path)[0]
    singles = [w for w in (encoding.decode([i]) for i in range(2000, 6000)) if re.fullmatch(" [a-z]{4,}", w) and len(encoding.encode_ordinary(w * 2)) == 2][:80]
    rows = [(i, w * 400) for i, w in enumerate(singles)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 40, path, train_documents=2).collect()
    scores = {r.doc_id: r.score for r in got}
    assert len(singles) == 80 and min(scores[i] for i in range(40)) > max(scores[i] for i in range(40, 80))


def test_lm_training_grows_in_parts(spark, monkeypatch):
    assert [lm.parts_of(n, 2000) * 2000 for n in (0, 1000, 640_000, 6_400_000)] == [2000, 2000, 20_000, 200_000]
    rng = np.random.default_rng(2)
    texts = [(i % 3, np.tile(rng.permutation(50), 20).astype(np.uint16).tobytes()) for i in range(30)]
    sample = spark.createDataFrame(texts, "part int, pieces binary")
    start = lm.untrained(np.full(300, 5))
    seen = []
    monkeypatch.setattr(lm, "mean_of", lambda states, own=lm.mean_of: seen.append(states.num_rows) or own(states))
    model = lm.fit_parts(start, sample, 3, np.dtype(np.uint16), 40)
    again = lm.fit_parts(start, sample.repartition(2), 3, np.dtype(np.uint16), 40)
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)
    ids, counts = np.frombuffer(b"".join(t for _, t in texts), np.uint16).astype(np.int64), np.full(30, 1000)
    assert model.score(ids, counts).sum() > 0.95 * start.score(ids, counts).sum() and seen[0] == 3


def test_model_is_a_causal_distribution():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 300, 3000)
    m = lm.train(ids, np.array([1500, 1500]), 400, steps=5)
    assert np.exp(m.within)[m.class_of == 3].sum() == pytest.approx(1)
    z = m.forward(rng.integers(0, 300, (2, 20)))["z"]
    assert np.exp(z).sum(axis=2) == pytest.approx(1, abs=1e-4)
    a = rng.integers(0, 300, (1, 20))
    b = a.copy()
    b[0, 12:] = 7
    assert np.allclose(m.forward(a)["z"][0, :12], m.forward(b)["z"][0, :12])
    one, two = m.score(ids[:100], np.array([100])), m.score(ids[:150], np.array([100, 50]))
    assert one[0] == pytest.approx(two[0], abs=1e-4)


@pytest.mark.parametrize("scale", [1, 40])
def test_score_is_the_plain_loop(scale):
    """Token by token through ``forward``, also where weights are so large that exponents must be shifted."""
    rng = np.random.default_rng(1)
    ids, counts = rng.integers(0, 300, 400), np.array([1, 39, 40, 41, 107, 172])
    m = lm.train(ids, counts, 400, steps=20)
    m.p = {k: v * np.float32(scale if k in ("q", "u") else 1) for k, v in m.p.items()}
    got, begin = m.score(ids, counts), 0
    for i, n in enumerate(counts):
        text, total, step = ids[begin : begin + n], 0.0, lm.STRIDE
        for t in range(n):
            nth = 0 if t < lm.WINDOW else (t - (lm.WINDOW - step)) // step
            seen = [lm.INPUTS if u == 0 else m.input_of[text[u - 1]] for u in range(nth * step, t + 1)]
            total += m.forward(np.array([seen]))["z"][0, -1, m.class_of[text[t]]] + m.within[text[t]]
        assert got[i] == pytest.approx(total / math.log(10), rel=2e-4)
        begin += n


@pytest.mark.parametrize("cached", [1 << 19, 30])
def test_subwords_decode_to_their_texts(texts, cached, monkeypatch):
    """Spans cut before white space, looked up or not: the same ids, that give back every text."""
    monkeypatch.setattr(lm, "CACHED", cached)
    path = registry.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    encoding, end = lm.encoder(path)
    pieces, rows = lm.Pieces(path), [t or "" for _, t in texts if len(t or "") < 5000] + ["  two  spaces \n", "\n", "a\n\n b\t", ""]
    for part in (rows[:10], rows[10:], rows, []):
        raw = [t.encode() for t in part]
        ids, counts = pieces(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        assert len(counts) == len(part) and counts.sum() == len(ids)
        for t, own in zip(part, np.split(ids, np.cumsum(counts)[:-1]), strict=len(part) > 0):
            want = [i for x in re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", t) for i in encoding.encode_ordinary(x)]
            assert own.tolist() == [*want, end] and encoding.decode(want) == t


def test_windows_score_every_token_once():
    counts = np.array([1, 39, 40, 41, 72, 73, 200])
    _, targets, scored, text = lm.windows(np.arange(counts.sum()), counts, -1)
    assert sorted(targets[scored].tolist()) == list(range(counts.sum()))


def test_gradients():
    rng = np.random.default_rng(0)
    m = lm.train(rng.integers(0, 300, 500), np.array([500]), 400, steps=1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(0, 300, (3, 10)), rng.integers(0, lm.CLASSES, (3, 10))
    _, g = m.gradients(x, y)
    for k, at in (("q", (1, 2)), ("k", (0, 3)), ("v", (2, 2)), ("o", (1, 1)), ("w1", (3, 4)), ("b1", (5,)), ("w2", (6, 1)), ("u", (2, 7)), ("pos", (4, 2)), ("e", (int(x[0, 0]), 3))):
        old = m.p[k][at]
        m.p[k][at] = old + 1e-4
        up = m.gradients(x, y)[0]
        m.p[k][at] = old - 1e-4
        down = m.gradients(x, y)[0]
        m.p[k][at] = old
        assert (up - down) / 2e-4 == pytest.approx(g[k][at], rel=1e-3, abs=1e-8)


def test_held_out_rule(spark):
    row = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 7 for r in row)
