"""Fingerprints, hard negatives and alignment against brute force, also on awkward rows."""

import hashlib
import re
import struct
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cargoframe.llm import alignment, fingerprints, hard_negatives
from cargoframe.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

PT = pytest.importorskip("public_tokenizers")
A, B = PT.path("byte_bpe_50k.json"), PT.path("piece_bpe_32k.model")
LINE = "one two three four five six seven eight nine ten eleven twelve"
ODD = [(1, LINE, "x", 1), (1, LINE, "x", 1), (2, None, "x", 2), (3, "", None, None), (4, " \n\t ", "x", 1),
       (None, LINE + " thirteen", "x", 1), (None, None, None, None), (5, "Fünf Wörter", "x", 1), (1, "other text of id one", "x", 1),
       (6, "w" * 3000 + " " + "long word text " * 700, "x", 1), (7, "a", "x", 1),
       (8, "say <|endoftext|> and </s>, ▁ too", "x", 1), (9, "  two  blanks\n \x00 tail ", "x", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and names the operators might use."""
    return spark.createDataFrame(ODD, "doc_id long, text string, FINGERPRINT string, range long")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# fingerprints

def spark_hash(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q" if kind(v) == "long" else "<i", int(v))
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


class Long(int):
    """A bigint; other ints are hashed as 32 bits."""


def kind(v):
    return "long" if isinstance(v, Long) else "int"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    shingles = [words[i:i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else ([words] if words else [])
    least = {}
    for s in shingles:
        h = spark_hash(*s)
        b = (h >> 56) + 128
        least[b] = min(h, least.get(b, h))
    if not least:
        return ""
    digits = []
    for i in range(256):
        value = least.get(i)
        for t in range(fingerprints.PROBES):
            if value is None:
                value = least.get(spark_hash(i, t) % 256)
        if value is None:
            value = min((spark_hash(i, b, "last"), v) for b, v in least.items())[1]
        digits.append("%x" % (spark_hash(Long(value), i) & 15))
    return "".join(digits)


def brute_likeness(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    p = sum(x == y for x, y in zip(a, b)) / 256
    return min(1.0, max(0.0, (p - 1 / 16) / (1 - 1 / 16)))


def check_edits(frame, source):
    out = fingerprints.edits(frame).withColumns({c: fingerprints.as_text(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})
    found = sorted(map(tuple, out.collect()), key=str)

    def signed_tie(text):
        return spark_hash(text)
    rows = [(d, t or "") for d, t in source]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -signed_tie(r[1])))
    want = []
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        h = len(text) // 2
        edited = text[:len(text) - h] + after[:h]
        a, b, c = map(brute_fingerprint, (text, edited, after))
        want.append((d, len(text), edited, a, b, brute_likeness(a, b), brute_likeness(a, c)))
    want.sort(key=str)
    assert [w[:5] for w in want] == [f[:5] for f in found]
    assert np.allclose([w[5:] for w in want], [f[5:] for f in found])


def test_fingerprints_of_documents(docs):
    check_edits(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_of_odd_rows(odd, none):
    check_edits(odd, [r[:2] for r in ODD])
    assert fingerprints.edits(none).count() == 0
    one = odd.filter("doc_id = 5")
    check_edits(one, [(5, "Fünf Wörter")])  # the only document is its own next


def test_fingerprints_estimate_jaccard(spark):
    words = [f"w{i}" for i in range(900)]
    texts = [" ".join(words[:600]), " ".join(words[:600]), " ".join(words[300:900])]
    rows = fingerprints.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    a, b, c = (r.fingerprint for r in rows.orderBy("doc_id").collect())
    assert a == b and len(a) == 16
    pairs = spark.createDataFrame([(a, b), (a, c)], "a array<long>, b array<long>")
    same, half = (r[0] for r in pairs.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect())
    assert same == 1 and abs(half - 296 / 896) < 0.12


def test_fingerprints_use_no_python(docs):
    plan = fingerprints.edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# hard negatives

def brute_mine(rows):
    """rows: (vec_id, label, vector or None)"""
    rows = [r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[2])]
    width = max((len(v) for *_, v in rows), default=0)
    used = list(dict.fromkeys(
        (i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v) + (0,) * (width - len(v)))
        for i, label, v in rows))
    matrix = np.array([u[2] for u in used], np.int64)
    out = []
    for k, (i, label, _) in enumerate(used):
        if i % 100:
            continue
        scored = sorted(((-int(s), u[0], u[1]) for s, u in zip(matrix @ matrix[k], used)))
        chosen = [(j, -s) for s, j, other in scored if other == label and j != i][:5]
        for positive, p in chosen:
            hits = [(j, -s) for s, j, other in scored if other != label and 80 * p <= -100 * s <= 100 * p][:5]
            out += [(i, positive, r, j, p, s) for r, (j, s) in enumerate(hits, 1)]
    return sorted(out)


def mined(frame):
    rows = hard_negatives.mine(frame).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    return sorted(map(tuple, rows))


SCHEMA = "vec_id long, embedding array<float>, label int, block long, Q string"


def test_hard_negatives_sql(spark, sf):
    assert compare(QUERIES["op12_hard_negatives"](spark, sf), connect(sf), ORACLES["op12_hard_negatives"]) is None


def test_hard_negatives_with_a_hot_cluster(spark):
    random = np.random.default_rng(3)
    centres = random.normal(size=(12, 16))
    which = np.where(random.random(6000) < 0.4, 0, random.integers(0, 12, 6000))
    x = centres[which] + 0.2 * random.normal(size=(6000, 16))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    labels = np.where(random.random(6000) < 0.4, 1, random.integers(0, 4, 6000))
    rows = [(i, x[i].tolist(), int(labels[i]), 0, "") for i in range(6000)]
    rows += rows[:50]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute_mine([(r[0], r[2], r[1]) for r in rows])


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 0.5], 2), (100, [1.0], 1), (100, [1.0, 0.0], 1),
            (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [1.0, 0.5], 2), (4, [1.0, 0.5], 2), (5, [0.9, 0.5], 3),
            (6, None, 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 1.0], None),
            (None, [1.0, 1.0], 1), (200, [], 1), (300, [-1.0, -0.5], 1), (11, [0.8, 0.5, 0.25], 2)]
    frame = spark.createDataFrame([(i, v, n, 0, "") for i, v, n in rows], SCHEMA)
    assert mined(frame) == brute_mine([(i, n, v) for i, v, n in rows])
    assert mined(frame.limit(0)) == [] and mined(frame.filter("vec_id = 6")) == []


def test_cells_come_by_falling_bound():
    random = np.random.default_rng(0)
    points, radius = random.normal(size=(7, 3)), random.random(7)
    index = hard_negatives.Index(points, points, radius, radius, *np.ones((3, 49), np.int64))
    q = random.normal(size=6)
    found = list(index.cells(q))
    assert sorted(c for _, c in found) == list(range(49))
    bounds = [b for b, _ in found]
    assert all(a >= b - 1e-2 for a, b in zip(bounds, bounds[1:]))
    for bound, cell in found:
        c = np.concatenate([points[cell // 7], points[cell % 7]])
        assert bound >= c @ q + np.linalg.norm(q[:3]) * radius[cell // 7] + np.linalg.norm(q[3:]) * radius[cell % 7] - 1e-9


def test_visits_leave_their_task_in_small_batches():
    random = np.random.default_rng(5)
    codes = random.normal(size=(40, 32))
    cells = np.arange(1600)
    index = hard_negatives.Index(codes, codes, np.ones(40), np.ones(40), cells, np.ones(1600, np.int64), np.full(1600, 100))
    anchors = random.integers(-200, 200, size=(60, 64))
    vectors = [v.astype("<i8").tobytes() for v in anchors]
    windows = [[{"slot": 1, "low": 1, "high": 5}]] * 60
    frame = pa.RecordBatch.from_pydict({
        "anchor_key": list(range(60)), "anchor_id": list(range(60)), "label": [0] * 60, "vector": vectors,
        "windows": windows, "reached": [None] * 60, "least": [None] * 59 + [1e9]})
    found = list(hard_negatives._visit(SimpleNamespace(value=index), True)(iter([frame])))
    assert len(found) > 1 and max(b.nbytes for b in found) < 8 << 20
    visits = {(r["block"], a["anchor_key"]) for b in found for r in b.to_pylist() for a in r["anchors"]}
    assert sum(len(r["anchors"]) for b in found for r in b.to_pylist()) == len(visits)
    for k, q in enumerate(anchors.astype(float)):
        cells, held, seeds = index.cells(q), 0, set()
        while held < hard_negatives.SEED:
            seeds.add(next(cells)[1])
            held += 100
        assert {b for b, a in visits if a == k} == (set(range(1600)) - seeds if k < 59 else set())


def test_the_sample_of_the_codebooks_is_bounded_where_it_is_taken(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIT", 100)
    rows = spark.range(5000).selectExpr("id AS vec_id", "id % 7 AS label", "array(id, id * 3) AS q")
    sample = hard_negatives._sample(rows, 5000)
    want = rows.orderBy(F.xxhash64("vec_id", "label", "q")).limit(100).collect()
    assert sorted(map(tuple, sample)) == sorted(tuple(r.q) for r in want)
    assert hard_negatives._sample(rows.limit(0), 0).size == 0


# alignment

def brute_align(texts):
    words = alignment.Vocabularies(A, B)
    groups, links, counts = {}, {}, Counter()
    for key, text in texts:
        a = words.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = words.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(words.a_bytes[i] for i in a) != raw or b"".join(words.b_bytes[i] for i in b) != raw:
            a, b = [], []
        b_end, end = {}, 0
        for j, i in enumerate(b):
            end += len(words.b_bytes[i])
            b_end[end] = j
        out, linked, end, from_a, from_b = [], [], 0, 0, 0
        for k, i in enumerate(a):
            end += len(words.a_bytes[i])
            if end in b_end:
                linked.append((i, b[b_end[end]]))
                out.append(f"{','.join(map(str, a[from_a:k + 1]))}|{','.join(map(str, b[from_b:b_end[end] + 1]))}")
                from_a, from_b = k + 1, b_end[end] + 1
        groups[key], links[key] = (len(a), len(b), out), linked
        counts.update(linked)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for key, (n_a, n_b, out) in groups.items():
        linked, text = links[key], ";".join(out)
        rows.append((n_a, n_b, len(out), len(linked), sum(counts[x] == top[x[1]] for x in linked),
                     sum(counts[x] for x in linked), hashlib.sha256(text.encode()).hexdigest() if n_a else "", text))
    return sorted(rows), counts


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def test_alignment_of_documents(docs):
    made = alignment.align(docs.repartition(5), A, B)
    want, counts = brute_align([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, made.documents.select(*COLUMNS).collect())) == want
    assert {(r.a_id, r.b_id): r["count"] for r in made.pairs.collect()} == dict(counts)
    for r in made.documents.limit(20).collect():
        assert len(np.frombuffer(r.a_ids, "<u2")) == r.n_a and len(np.frombuffer(r.b_ids, "<u2")) == r.n_b


def test_alignment_of_odd_rows(odd, none):
    made = alignment.align(odd, A, B)
    want, _ = brute_align([(i, r[1]) for i, r in enumerate(ODD)])
    assert sorted(map(tuple, made.documents.select(*COLUMNS).collect())) == want
    by_id = {r.doc_id: r for r in made.documents.collect()}
    assert by_id[8].n_a == 0 and by_id[8].groups_sha256 == "" and by_id[9].n_a > 0
    empty = alignment.align(none, A, B)
    assert empty.documents.count() == 0 and empty.pairs.count() == 0


def test_known_words_with_other_punctuation_are_not_encoded_again():
    texts = ["Zarquem zarquem", "zarquem, zarquem. (zarquem) zarquem;\nzarquem <unk> zarquem!", None, "", "</s> zarquem <|endoftext|>"]
    encoder = alignment.Encoder(A, B)
    encoder.units = alignment.token_ids.Encoder(A, plain=True)
    made = list(encoder.batch(texts[:1]))
    before = encoder.units.noted
    made += encoder.batch(texts[1:])
    # of the new chunks only signs, the word at the start of a line and the named tokens are new
    assert before == 2 and b"zarquem" not in b" ".join(encoder.units.long) and encoder.units.noted < 25
    assert len(encoder.number) == 10
    want, _ = brute_align(list(enumerate(texts)))
    assert sorted((len(a), len(b), n, groups.decode()) for a, b, groups, n in made) == sorted((*r[:3], r[-1]) for r in want)


def test_alignment_query(spark, sf, docs):
    rows = QUERIES["op13_alignment"](spark, sf)
    assert sorted(rows.columns) == sorted(["doc_id", *COLUMNS[:-1]])
    assert rows.count() == docs.count()


def test_pair_hash_is_minimal_and_verified():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 31, 20_000))
    shard = (alignment.mix(keys.view(np.uint64)) & np.uint64(alignment.SHARDS - 1)).astype(int)
    made = alignment.PairHash({s: alignment.build_shard(keys[shard == s]) for s in range(alignment.SHARDS)})
    assert sorted(made.slots(keys)) == list(range(len(keys)))
    assert (made.slots(np.setdiff1d(np.arange(1000), keys)) == -1).all()


def test_every_linked_pair_lies_within_the_bound():
    words = alignment.Vocabularies(A, B)
    assert words.pair_bound() < alignment.MOST_PAIRS


def test_tree_sum(spark):
    rows = [(t, b, np.arange(3, dtype="<i8").tobytes()) for t in range(40) for b in range(2)]
    out = alignment.tree_sum(spark.createDataFrame(rows, alignment._VECTOR), 40).collect()
    assert sorted((r.block, np.frombuffer(r.counts, "<i8").tolist()) for r in out) == [(0, [0, 40, 80]), (1, [0, 40, 80])]
