"""Operators against brute force, on the smallest tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cargoframe.llm import (decontaminate, hilbert, html_extract, license_scan, line_rules, packing, signature_tree,
                            substring, toxicity, wavelet)
from cargoframe.llm.components import components
from cargoframe.llm.tokens import Encoder
from cargoframe.sources.scratch import place

PT = pytest.importorskip("public_tokenizers")
BYTE, WORD = PT.path("byte_bpe_50k.json"), PT.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, one long word and clashing column names."""
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, line, "en", "s", 5, 0.5, 1), (1, line, "en", "s", 5, 0.5, 1), (2, None, None, None, None, None, None),
            (3, "", "en", None, 0, 0.5, 2), (4, " \n ", "en", "s", 3, 0.5, 2), (None, line + " x", "de", "s", 5, 0.5, 3),
            (5, "w" * 5000 + " " + line, "en", "s", 9, 0.1, 4), (6, "MIT License and mit license", "en", "s", 9, 0.1, 4)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_chunked_encoding_equals_whole():
    tricky = ["", " ", "a  b", "\n a", "a\n b \n\nc ", "x<|endoftext|>y", "é ́x", "don't we'll", "a\t b", "\x1c a\x85 c", None]
    for path in (BYTE, WORD):
        encoder = Encoder(path)
        for text, ids in zip(tricky, encoder.batch(tricky)):
            assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def packed(frame, spark_texts):
    encoder = Encoder(BYTE)
    rows = packing.pack(frame, BYTE).toPandas()
    for _, piece in rows.iterrows():
        assert zlib.crc32(piece.token_ids) == piece.ids_crc32 and len(piece.token_ids) == 4 * piece.length
    for sequence, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert (part.length.cumsum() - part.length == part.offset).all() and part.length.sum() <= 1024
    for doc, part in rows.groupby("doc_id"):
        ids = [*encoder.tokenizer.encode(spark_texts[doc] or "", add_special_tokens=False).ids, 0]
        part = part.sort_values("start")
        assert np.frombuffer(b"".join(part.token_ids), "<u4").tolist() == ids
    return rows


def test_packing(spark, docs, texts, odd, none):
    rows = packed(docs.repartition(5), texts)
    assert rows.doc_id.nunique() == len(texts)
    assert rows.length.sum() / (1024 * rows.sequence_id.nunique()) > 0.95
    assert packing.pack(odd, BYTE).filter("doc_id IS NULL").count() == 1
    assert packing.pack(odd, BYTE).filter("doc_id = 2").first().length == 1
    assert packing.pack(none, BYTE).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 300, 3000).astype(np.uint32)
    made = wavelet.WaveletMatrix.build(ids, 16)
    assert made.decode().tolist() == ids.tolist()
    for i in range(0, 3000, 101):
        assert made.access(i) == ids[i] and made.rank(7, i) == (ids[:i] == 7).sum()
    at = np.flatnonzero(ids == 7)
    assert [made.select(7, k) for k in range(len(at))] == at.tolist()


def test_wavelet_files(spark, docs, texts, odd, none):
    path, encoder, start = place(spark, "t"), Encoder(WORD), 0
    wavelet.write_shards(docs, path, WORD, shard_tokens=2000)
    rows = {r.doc_id: r for r in wavelet.read_documents(spark, path).collect()}
    counts = Counter()
    for doc in sorted(texts):
        ids = [*encoder.tokenizer.encode(texts[doc], add_special_tokens=False).ids, 2]
        counts.update(ids)
        assert (rows[doc].start, rows[doc].n_tokens) == (start, len(ids))
        assert np.frombuffer(rows[doc].token_ids, "<u4").tolist() == ids
        start += len(ids)
    token, n = counts.most_common(3)[2]
    assert wavelet.count_token(spark, path, token).first().n == n == wavelet.find_token(spark, path, token).count()
    for frame, size in ((odd, 8), (none, 0)):
        path = place(spark, "t")
        wavelet.write_shards(frame, path, WORD)
        assert wavelet.read_documents(spark, path).count() == size


def test_license_scan(docs, texts, odd, none):
    for row in license_scan.scan(docs).collect():
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[row.doc_id]))
        at = {(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(found))
              if found[i:i + len(phrase.split())] == phrase.split()}
        assert (row.n_words, row.n_base) == (len(found), len(at))
        assert row.base_labels == ",".join(sorted({x for _, x in at}))
        assert (row.first_word, row.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert {x for _, x in at} <= set(row.labels.split(","))
    got = {(r.doc_id, r.n_base, r.n_words) for r in license_scan.scan(odd).collect()}
    assert (6, 2, 5) in got and (2, 0, 0) in got and license_scan.scan(odd).count() == 8
    assert license_scan.scan(none).count() == 0


def brute_removed(texts, window):
    first = {}
    for doc in sorted(texts):
        w = words(texts[doc])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), doc)
    for doc in texts:
        w = words(texts[doc])
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < doc:
                gone[i:i + window] = [True] * window
        yield doc, w, gone


def test_substring(docs, texts, odd, none):
    rows = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    for doc, w, gone in brute_removed(texts, 13):
        kept = [x for x, g in zip(w, gone) if not g]
        assert (rows[doc].n_words, rows[doc].n_removed) == (len(w), sum(gone))
        assert rows[doc].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert words(rows[doc].kept_text) == kept
    assert sum(r.n_removed for r in rows.values()) > 0
    found = substring.remove_repeats(odd).collect()
    assert sorted(r.n_removed for r in found if r.doc_id == 5) == [14] and len(found) == 8
    assert [r.n_removed for r in found if r.doc_id == 1] == [14, 14]  # the null id comes first
    assert substring.remove_repeats(none).count() == 0


def test_html_without_marked_part(spark):
    """The tree alone decides: a branch that all pages of a host share goes, differing ones stay."""
    html = "<html><body><div class='bar'>Same here</div><div class='text'>Own words %d</div></body></html>"
    rows = [(i, f"http://h.org/{i}", html % i) for i in range(6)] + [(9, "http://few.org/", html % 9)]
    found = {r.page_id: (r.text, r.n_removed) for r in html_extract.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {**{i: (f"Own words {i}", 1) for i in range(6)}, 9: ("Same here\nOwn words 9", 0)}


PAGE = ("<html><body><nav><a href=/>Home</a></nav><article><h1>T%d &amp; co</h1><p>Own  text\n%d<br>here.<p>More %d</p>"
        "<div class='comments'><p>Nice!</p></div></article><aside>Buy</aside><footer>Foot</footer></body></html>")
BARE = "<body><div class=top>Same banner line</div><div class=body>Story number %d tells something new</div></body>"


def test_html(spark, none):
    rows = [(i, "http://a.x/1", PAGE % (i, i, i)) for i in range(6)]
    rows += [(10 + i, "http://b.x/1", BARE % i) for i in range(6)] + [(20, None, None), (21, "x", ""), (21, "x", "")]
    found = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3].text == "T3 & co\nOwn text 3 here.\nMore 3" and found[3].n_chars == len(found[3].text)
    assert found[12].text == "Story number 2 tells something new" and found[12].n_removed == 1
    assert found[20].text == found[21].text == "" and len(found) == 14
    empty = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert html_extract.extract(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_near_duplicates(docs, texts, odd, none, k, num):
    def shingles(text):
        w = words(lower(text))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])

    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    rows = signature_tree.near_duplicates(docs, k, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {d: (len(sets[d]), root[d]) for d in texts}
    assert signature_tree.near_duplicates(odd, k, num, 100).count() == 8
    assert signature_tree.near_duplicates(none, k, num, 100).count() == 0
    kept = signature_tree.keep_one(docs, k, num, 100)
    assert {r.doc_id for r in kept.collect()} == set(root.values()) and kept.columns == docs.columns


def test_near_copies_around_split_size(spark):
    """Full nodes with sets on both sides of SPLIT_SIZE: many variants, alike through one text only."""
    rng, rows, k, num = np.random.default_rng(3), [], 4, 85
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(135)]
        rows.append(base)
        for i in range(400):
            w = base[:132] if i % 4 else list(base)
            for j in rng.choice(np.arange(4, 128), 2, replace=False):
                w[j] = f"g{group}c{i}x{j}"
            rows.append(w)
    sets = [frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for w in rows]
    root = list(range(len(rows)))
    for low in range(0, len(rows), 401):
        for a in range(low, low + 401):
            for b in range(a + 1, low + 401):
                if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and root[a] != root[b]:
                    least, most = sorted((root[a], root[b]))
                    root[low:low + 401] = [least if r == most else r for r in root[low:low + 401]]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in signature_tree.near_duplicates(frame, k, num, 100).collect()}
    assert [got[i] for i in range(len(rows))] == root


def test_near_copies_across_heads(spark):
    """A chain whose ends are not alike is still one component."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"c{i}" if j in range(3 * i, 3 * i + 3) else w for j, w in enumerate(base))) for i in range(60)]
    rows = [(i, " ".join(["x" if j < 2 * i else w for j, w in enumerate(base)])) for i in range(40)]
    got = {r.doc_id: r.component_id for r in signature_tree.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert set(got.values()) == {0}


def test_hilbert_is_a_walk(spark):
    from pyspark.sql import functions as F

    cells = spark.range(512).select(*[F.shiftright("id", 3 * j).bitwiseAND(F.lit(7)).cast("int").alias(f"d{j}") for j in range(3)])
    rows = cells.withColumn("h", hilbert.hilbert_index([F.col(f"d{j}") for j in range(3)], 3)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(512))
    assert all(sum(abs(a[j] - b[j]) for j in range(3)) == 1 for a, b in zip(rows, rows[1:]))


def test_shards(docs, texts, odd, none):
    rows = hilbert.assign(docs).toPandas()
    assert sorted(rows.doc_id) == sorted(texts)
    for r in rows.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r._asdict()["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.35 * sizes.mean()
    assert rows.groupby("text_crc32").shard.nunique().max() == 1
    assert hilbert.assign(odd).count() == 8 and hilbert.assign(none).count() == 0


def test_toxicity(spark, docs, sf, odd, none):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    many = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = toxicity.train(many, labels)
    both = toxicity.score(many, model).join(labels, "doc_id").select("doc_id", "score", "toxic").toPandas()
    held = both[[zlib.crc32(str(d).encode()) % 5 == 0 for d in both.doc_id]]
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.9
    assert toxicity.score(odd.drop("score"), model).filter("score IS NULL").count() == 0
    assert toxicity.train(many, labels.limit(0)) == {"share": 0.0}
    assert toxicity.score(none.drop("score"), model).count() == 0


def test_line_rules(docs, texts, odd, none):
    for r in line_rules.judge(docs).collect():
        text, w = texts[r.doc_id], words(texts[r.doc_id])
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        twice = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert line_rules.judge(odd).count() == 8 and line_rules.judge(none).count() == 0


def test_common_lines(spark):
    shared = "cookie settings and terms of this very site apply to all who read it here today\n" * 4
    rows = [(i, shared + " ".join(f"u{i}v{j}" for j in range(60 if i % 2 else 20)), "h") for i in range(24)]
    got = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].n_common_words == 64 and not got[2].kept


def test_common_lines_of_a_large_host(spark):
    """A line on a twentieth of many documents is common, a short one is not."""
    rows = [(i, ("read our terms and cookie settings here\n" if i % 20 == 0 else "so it goes\n" if i % 20 == 1 else "")
             + " ".join(f"u{i}v{j}" for j in range(60)), "h") for i in range(400)]
    got = line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.n_common_words for r in got} == {i: 0 if i % 20 else 7 for i in range(400)}


def test_decontamination(spark, docs, texts, odd, none, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))
    items = {r.item_id: plain(r.text) for r in benchmark.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {plain(t)} "}
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_items(docs, benchmark).collect()}
    assert want and want <= set(got) and all(got[p].distance == 0 for p in want)
    assert decontaminate.find_items(odd, benchmark).count() == decontaminate.find_items(none, benchmark).count() == 0
    assert decontaminate.find_items(docs, benchmark.limit(0)).count() == 0


def test_decontamination_recall(spark, sf):
    """Items with a tenth of their words changed, dropped or doubled, inside other words."""
    rng, rows = np.random.default_rng(5), []
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    for item in benchmark.collect():
        w = item.text.split()
        for j in rng.permutation(len(w))[:len(w) // 10]:
            w[j] = [f"zz{j}", "", f"{w[j]} {w[j]}"][int(rng.integers(3))]
        rows.append((item.item_id, " ".join([f"a{i}" for i in range(40)] + w + [f"b{i}" for i in range(40)])))
    found = decontaminate.find_items(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert found.filter("doc_id = item_id").count() >= 0.9 * len(rows)


def test_decontamination_recall_per_length(spark):
    """Items of every length with a fifth of their words edited: spread evenly or at random, replaced or mixed."""
    rng, items, rows, short = np.random.default_rng(8), [], [], []
    for n in range(5, 41):
        for case in range(100):
            item = n * 100 + case
            w = [f"i{item}w{j}" for j in range(n)]
            items.append((item, " ".join(w)))
            edits = n // 5
            spread = [(j + 1) * (n - edits) // (edits + 1) + j for j in range(edits)]
            for j in spread if case % 2 else rng.permutation(n)[:edits]:
                w[j] = [f"zz{j}", "", f"{w[j]} yy{j}"][0 if case % 4 < 2 else int(rng.integers(3))]
            rows.append((item, " ".join([f"a{i}" for i in range(20)] + w + [f"b{i}" for i in range(20)])))
    found = decontaminate.find_items(spark.createDataFrame(rows, "doc_id long, text string").repartition(8),
                                     spark.createDataFrame(items, "item_id long, text string").repartition(8))
    got = Counter(r.doc_id // 100 for r in found.filter("doc_id = item_id").collect())
    for n in range(5, 41):
        width, repeats = decontaminate._plan(n, 0.8)
        short += [(n, width, repeats, got[n])] if got[n] < 99 else []
    assert not short and sum(got.values()) >= 0.998 * len(rows)


def test_rows_without_id(spark):
    """Copies and benchmark items leave without an id too; other rows without an id stay."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join(base[:59] + ["end"])
    rows = [(1, " ".join(base)), (None, near), (None, "own words of a row that has no id at all"),
            *[(None, " ".join(f"n{i}" for i in range(m))) for m in (60, 59)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.component_id or 0 for r in signature_tree.near_duplicates(docs).collect()) == [0, 0, 0, 1, 1]
    kept = signature_tree.keep_one(docs).collect()
    assert len(kept) == 3 and near not in {r.text for r in kept} and {r.doc_id for r in kept} == {1, None}
    benchmark = spark.createDataFrame([(7, " ".join(base[10:40]))], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.drop_found(docs, benchmark).collect()) == sorted(t for _, t in rows[2:])


def _texts_of(html):
    return [text for _, text in html_extract._inside(html_extract.parse(html)[0])[1]]


@pytest.mark.parametrize("html", [
    "<html><head><title>T</title><meta charset=utf-8><body><article><p>Real text</p></article></body></html>",
    "<html><head><title>T</title><noscript><p>Turn on</p></noscript><p>Real text</p>",
    "<body><div class='page-with-sidebar'><article><p>Real text</p></article></div>",
    "<body><article class='post no-comments'><p>Real text</p></article>",
    "<body><div class='menu'><main><p>Real text</p></main></div><div class='x'>Side</div>",
    "<body><div class='widget'><article><p>Odd</p></article></div><article><p>Real text</p></article>",
    "<body><article><p>Real text</p></article><div class='comments'><article><p>Nice!</p></article></div>",
    "<body><div class='text'><p>Real text</p></div><div class='comments'><article class=comment><p>Nice!</p></article></div>",
    "<body><article><p>Real text</p><div class='share-bar'>Share</div><header></header></article>",
])
def test_html_names_and_open_heads(html):
    assert _texts_of(html) == ["Real text"]


def test_votes_of_neighbouring_diagonals_add_up(spark):
    notice = next(n for n in license_scan.NOTICES if n.startswith("permission is hereby"))
    words = notice.split()
    for i, at in enumerate((5, 11, 17, 23)):
        words.insert(at + i, "indeed")
    rows = [(1, "Some text. " + " ".join(words) + " more"), (2, "permission is hereby granted free of course"), (3, notice)]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[i].labels for i in (1, 2, 3)] == ["mit", "", "mit"]
    assert found[1].score >= license_scan.COVERAGE and found[3].score == 1.0


def test_chunked_encoding_of_awkward_texts():
    import random

    draw = random.Random(5)
    bits = ["A", "b", "É", "é", "H̱", "İ", "Σ", "ß", " ", "  ", "\n", "\t", ".", ",", "...", "'s", "'S", "1", "12.5",
            "<|endoftext|>", "<|ENDOFTEXT|>", "Ab,", " ", "中文", "🙂", "ﬁ", "ǅ", "|", "\x1c", "​", "ª"]
    made = [glue.join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for glue in ("", " ") for _ in range(1500)]
    for path in (BYTE, WORD):
        encoder = Encoder(path)
        for low in range(0, len(made), 500):
            for text, ids in zip(made[low:low + 500], encoder.batch(made[low:low + 500])):
                assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_units_of_texts_equal_whole():
    import random

    draw = random.Random(9)
    bits = ["A", "é", "É", "H̱", "İ", "İ...", " ÷b", "×", "h", "\u0331", "\u0301", "<", "\u0338", "’", "\u3000", "\u00a0", "'", "'s",
            "'re", " ", "  ", "\n", "\r\n", "\x00", "q" * 22, "z" * 23, "y" * 24, "Ж", "ȿ", "½", "_", "7", "<|ENDOFTEXT|>", "<|endoftext|>"]
    made = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    for path in (BYTE, WORD):
        encoder = Encoder(path)
        assert encoder.pattern is not None
        for text, ids in zip(made, encoder.batch(made)):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_learnt_without_their_marks():
    """A word is encoded once, whatever stands around it, and what is remembered is small."""
    encoder = Encoder(WORD)
    encoder.batch(["word house Élan"])
    known = encoder.noted
    encoder.batch(["Word. house,\nÉLAN WORD!", "house\tword"])
    assert encoder.noted <= known + 3
    names = [chr(97 + a) + chr(97 + b) + chr(97 + c) + chr(97 + d) for a in range(26) for b in range(26) for c in range(26) for d in range(4)]
    encoder.batch([" ".join(names)])
    held = sum(x.nbytes for x in (encoder.keys, encoder.slots, encoder.starts, encoder.counts, encoder.ids))
    assert encoder.noted > 70_000 and held < 16 << 20


def test_slices_of_texts_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a " * 400_000, None, "b " * 400_000, "", "c " * 400_000, "d", "e " * 900_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [p.column(0).to_pylist() for p in signature_tree._batches([batch])]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= signature_tree.PIECE for p in parts)
    size = pa.array([len(t or "") for t in texts])
    packed = pa.RecordBatch.from_arrays([pa.array(texts), size], ["packed", "size"])
    assert [len(p) for p in parts] == [p.num_rows for p in signature_tree._batches([packed])]


def test_batches_for_python_stay_small(spark, docs):
    from cargoframe.sources.scratch import ship

    ship(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower() in ("4m", "4194304", "4194304b")
