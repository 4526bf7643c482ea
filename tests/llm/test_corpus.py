import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from effectlake.llm import decontam, exact_dedup, langid, mixing, ngram_join, piece_ids, quality, sharding, suffix_dedup, textbytes, token_planes, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, rep string, n int, copies int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    long_ = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
    texts = [None, "", "   \n", "one two", "One TWO", "one two", "the same words again and again here", "the same words again and again here", "é" * 500, "12 34 !!", long_, long_ + " more", "a" * 150_000]
    rows = [(k, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, 7, "x", 1, 1) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "one two", "de", None, 3, 1, "y", 2, 2), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def test_exact_dedup(odd, empty):
    rows = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256(lower(r.text).encode()).hexdigest()].append(r.doc_id)
    for r in rows:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert (r.group_size, r.keep_id) == (len(groups[r.text_sha256]), max(ids, default=None)) and r.kept == (r.doc_id == r.keep_id)
    assert len(rows) == odd.count() and exact_dedup.exact_dedup(empty).count() == 0


def test_digest_index_keeps_older_rows(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = lambda *ids: spark.createDataFrame([(i, bytearray([i % 2])) for i in ids], "doc_id long, digest binary")
    index.ingest(batch(1, 3, 2))
    index.ingest(batch(9, 8))
    want = [(b"\0", 2), (b"\1", 3)]
    assert sorted((bytes(r.digest), r.keep_id) for r in index.rows().collect()) == want
    # A session that knows nothing of it opens the index by its path, and finds in it what the first one stored.
    index.close()
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"))
    again.ingest(batch(0, 1, 5))
    assert again.buckets == 4 and sorted((bytes(r.digest), r.keep_id) for r in again.rows().collect()) == want


def test_lookup_table_takes_turns():
    shards, slots = [f"s{k}" for k in range(7)], 101
    owner = sharding.lookup_table(shards, slots)
    want, turn = {}, 0
    while len(want) < slots:
        start, skip = sharding.preference(shards[turn % 7], slots)
        want[next(s for j in range(slots) if (s := (start + j * skip) % slots) not in want)] = turn % 7
        turn += 1
    assert owner == [want[k] for k in range(slots)] and max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    less = sharding.lookup_table(shards[:-1], slots)
    assert sum(a != b for a, b in zip(owner, less, strict=True)) < slots / 2
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_sharding_rows(odd, empty):
    rows = sharding.place(odd, ["a", "b", "c"], 101).collect()
    assert len(rows) == odd.count() and len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows}) and sharding.place(empty, ["a"], 11).count() == 0


def brute_removed(texts):
    times = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 199):
            if times[t[p : p + 200]] > 1:
                covered[p : p + 200] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~covered[:-1]])
        out.append((len(t), int(covered.sum()), int((covered[:-1] & ~np.concatenate(([False], covered[:-2]))).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(documents, odd, empty):
    for docs in (documents, odd):
        rows = docs.collect()
        want = Counter((r.doc_id, *x) for r, x in zip(rows, brute_removed([(r.text or "").encode() for r in rows]), strict=True))
        got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).drop("kept").collect())
        assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 3)
    rng = np.random.default_rng(2)
    line = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = line(400)
    docs = [(k, line(int(rng.integers(50, 300))) + shared + line(90)) for k in range(12)]
    got = sorted(tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).drop("kept").collect())
    assert got == [(k, *x) for (k, _), x in zip(docs, brute_removed([t.encode() for _, t in docs]), strict=True)]


def test_suffix_family_opens_again(spark, tmp_path):
    """A batch meets what another session stored; levels of one size merge; entries are in order of their bytes."""
    rng = np.random.default_rng(5)
    line = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = line(300)
    batches = [[(10 * k + j, line(400) + (shared if j == 0 else "") + line(50)) for j in range(4)] for k in range(4)]
    rows = lambda docs: suffix_dedup.anchor_rows(spark.createDataFrame([(i, 0, t) for i, t in docs], "doc_id long, tk int, text string"))
    family = suffix_dedup.IndexFamily(spark, str(tmp_path / "f"), 4)
    assert family.add(rows(batches[0])).count() == 0 and len(family.levels) == 1
    first = family.add(rows(batches[1]))
    assert first.count() > 0 and len(family.levels) == 1
    family.close()
    again = suffix_dedup.IndexFamily(spark, str(tmp_path / "f"))
    assert again.buckets == 4 and again.levels == family.levels
    third = again.add(rows(batches[2]))
    # Anchors at the edges of the passage depend on what is around it; those within are the same everywhere.
    inner = {bytes(r.gram) for r in first.collect()} & {bytes(r.gram) for r in third.collect()}
    assert inner and {r.n for r in third.collect() if bytes(r.gram) in inner} == {3} and len(again.levels) == 2
    for _, name in again.levels:
        for part in spark.table(name).select("gram", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("gram").alias("g")).collect():
            assert [bytes(x) for x in part.g] == sorted(bytes(x) for x in part.g)
    entry = spark.table(again.levels[0][1]).where("n = 2").first()
    assert dict(batches[0] + batches[1])[entry.doc_id].encode()[entry.at : entry.at + 32] == bytes(entry.gram)
    again.close()


def test_windows_that_share_a_hash(monkeypatch):
    """Were all hashes alike, bytes would still decide."""
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda c: np.zeros(len(c) - 199, np.uint64))
    rng = np.random.default_rng(3)
    a, b = rng.integers(97, 105, 260, dtype=np.uint8).tobytes(), rng.integers(97, 105, 260, dtype=np.uint8).tobytes()
    rows = [{"g": b"g", "ctx": k, "left": 0, "n": 1, "context": c} for k, c in enumerate((a, b, a[:230] + b[:30]))]
    assert [(r["ctx"], r["starts"], r["ends"]) for r in suffix_dedup._compare(rows)] == [(0, [0], [230]), (2, [0], [230])]


def brute_join(rows):
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids, comp = sorted(sets), {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def test_ngram_join(documents, odd, empty):
    for docs in (documents, odd.where("doc_id IS NOT NULL")):
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_join(docs).collect()} == brute_join(docs.collect())
    assert ngram_join.similarity_join(odd).count() == odd.count() and ngram_join.similarity_join(empty).count() == 0


def test_ngram_join_of_frequent_tokens(spark, monkeypatch):
    """Chains of near copies, with hardly any token that is rare."""
    monkeypatch.setattr(ngram_join, "RARE", 2)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    docs, own = [], list(base)
    for k in range(40):
        docs.append((k, " ".join(own)))
        own = list(base) if k % 9 == 8 else own
        own[int(rng.integers(0, 120))] = f"v{rng.integers(0, 6)}"
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_join(docs).collect()} == brute_join(docs.collect())


def test_mixing(documents, odd, empty):
    for docs in (documents, odd):
        rows = mixing.mix(docs).collect()
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect())) and len(rows) == docs.count()
        by = defaultdict(list)
        for r in rows:
            assert r.taken <= 3 * r.size
            by[r.source].append(r)
        sizes = {s: sum(r.size for r in x) for s, x in by.items()}
        order = sorted(by, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        free, left, target = set(order), float(sum(sizes.values())), {}
        while free:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 3 * sizes[s]]
            target |= {s: 3.0 * sizes[s] for s in over} if over else share
            left -= sum(3.0 * sizes[s] for s in over)
            free = free - set(over) if over else set()
        for s, x in by.items():
            assert x[0].source_size == sizes[s] and np.isclose(x[0].target, target[s])
            assert abs(sum(r.taken for r in x) - target[s]) <= max(r.size for r in x)
    assert mixing.mix(empty).count() == 0
    plan = {(r.doc_id, r.source): r.copies for r in mixing.mix(documents).collect()}
    assert Counter(r.doc_id for r in mixing.mix_documents(documents).collect()) == Counter({k[0]: c for k, c in plan.items() if c})


def test_token_planes(documents, odd, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(token_planes.default_tokenizer())
    for docs in (documents, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        got, start = {r.doc_id: r for r in token_planes.encode_and_read(docs).collect()}, 0
        for r in sorted(docs.collect(), key=lambda r: r.doc_id):
            ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert token_planes.encode_and_read(odd).count() == odd.count() and token_planes.encode_and_read(empty).count() == 0


SIGNS = ["a", "B", "é", "×", "ª", "²", "1", "23", " ", "  ", "\n", "\r", "\t", "\u00a0", "\u3000", "\u2003", "\x85", "\x1c", "'s", "'ll", "<|endoftext|>", "<|", "日本", "Ж", "!", "_", "\x00", "don't", "\U0001f600", ""]


def test_pieces_encode_like_the_whole():
    own = piece_ids.Encoder(token_planes.default_tokenizer(), 1 << 16)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(SIGNS, rng.integers(0, 30))) for _ in range(8000)] + ["a" * 1000, "x y" * 50 + "\n\n", " ", "a ", " a"]
    for row, data, offsets in textbytes.slices(pa.array(texts), 4000):
        sizes, ids = own.encode(data, offsets)
        cut = np.cumsum(sizes)[:-1]
        want = own.own.encode_batch_fast(texts[row : row + len(sizes)], add_special_tokens=False)
        assert [x.tolist() for x in np.split(ids, cut)] == [e.ids for e in want]
    assert own.pieces.large.nbytes() <= 1 << 16


def test_crc_of_two_strings():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 100, b"\0" * 70000)):
        assert token_planes.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_planes_of_small_chunks(spark, documents, tmp_path):
    """Documents that run over many chunks, and chunks that end with a document."""
    path = str(tmp_path / "t")
    token_planes.write(documents, path, chunk_ids=7)
    whole = {tuple(r) for r in token_planes.encode_and_read(documents).collect()}
    assert {tuple(r) for r in token_planes.read(spark, path, str(tmp_path / "s")).collect()} == whole
    index = spark.read.parquet(f"{path}/index").orderBy("first_id").collect()
    assert [r.first_id for r in index] == np.cumsum([0, *[r.n_ids for r in index]])[:-1].tolist() and sum(r.n_docs for r in index) == documents.count()


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "short item"), (3, None), (10, "short ITEM")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ALPHA, beta gamma delta epsilon zeta eta theta iota kappa! y"), (2, "a short--item b"), (3, None), (4, "beta gamma")], "doc_id long, text string")
    rows = {r.doc_id: r for r in decontam.scan(docs, bench).collect()}
    assert [(k, r.n_words, r.n_hit, sorted(r["items"])) for k, r in sorted(rows.items())] == [(1, 12, 10, ["1"]), (2, 4, 2, ["10", "2"]), (3, 0, 0, []), (4, 2, 0, [])]
    assert [r.text for r in decontam.remove_spans(docs, bench).orderBy("doc_id").collect()] == ["x , " + " " * 8 + "! y", "a -- b", None, "beta gamma"]
    assert [r.doc_id for r in decontam.drop_documents(docs, bench).orderBy("doc_id").collect()] == [3, 4]
    assert decontam.scan(odd, bench).count() == odd.count() and decontam.scan(empty, bench).count() == 0 and decontam.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def brute_hits(text, items):
    """Number of words, of hit words, and the items with an occurring window."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    ws, hit, found = cut(text), set(), set()
    for i, t in items:
        bw = cut(t)
        k = min(10, len(bw))
        for a in range(len(bw) - k + 1) if k else ():
            for b in range(len(ws) - k + 1):
                if ws[b : b + k] == bw[a : a + k]:
                    hit |= set(range(b, b + k))
                    found.add(str(i))
    return len(ws), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("most", [decontam.MAX_BYTES, 0])
def test_decontamination_by_brute_force(spark, monkeypatch, most):
    """Items of 0 to 14 words, over an alphabet so small that windows meet everywhere; ids and rows repeat; names clash."""
    rng = np.random.default_rng(7)
    line = lambda n: " ".join(rng.choice(["a", "B", "c3", "é"], n))
    items = [(k, line(k % 15)) for k in range(3, 45)] + [(99, None)]
    docs = [(k % 30 if k % 11 else None, line(int(rng.integers(0, 40))), 1, 2) for k in range(70)]
    docs += docs[:3] + [(5, None, 1, 2), (6, "x, " + items[13][1].replace(" ", " -- ") + "!", 3, 4), (7, line(1500) + items[30][1], 5, 6)]
    for few in (items, items[-18:-15]):
        got = decontam.scan(spark.createDataFrame(docs, "doc_id long, text string, id_ int, hits int"), spark.createDataFrame(few, "item_id long, text string"), max_bytes=most)
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got.collect())
        assert got == Counter((d[0], *brute_hits(d[1], few)) for d in docs)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, id_ int, hits int"), spark.createDataFrame(items[9:12], "item_id long, text string")
    kept = decontam.drop_documents(frame, bench)
    assert kept.columns == frame.columns and Counter(map(tuple, kept.collect())) == Counter(d for d in docs if not brute_hits(d[1], items[9:12])[1])
    assert decontam.remove_spans(frame, bench).columns == frame.columns and decontam.remove_spans(frame, bench).count() == len(docs)


def test_language(documents, odd, empty):
    rows = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert {r.lang_pred for r in langid.identify(odd).where("doc_id IN (0, 1, 2, 9)").collect()} == {"und"}
    assert langid.identify(empty).count() == 0 and langid.identify(odd).count() == odd.count()


def test_quality(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    assert quality.classify(odd).count() == odd.count() and quality.classify(empty).count() == 0 and quality.keep_good(empty).count() == 0


def brute_pages(rows):
    out = Counter()
    for i, _, h, *_ in rows:
        same = [j for j, _, x, *_ in rows if (x or "") == (h or "")]
        first = min((j for j in same if j is not None), default=None)
        raw, revisit = (h or "").encode(), i != first
        out[i, len(raw), warc.digest_of(raw), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def test_warc(spark, tmp_path):
    """Repeated rows, null ids, urls and payloads, one id with two payloads, columns of the names used within."""
    html = ["<p>" + "x" * 100_000, "<p>ü</p>", "", None, "<p>ü</p>", "a\r\n\r\nWARC/1.1\r\n", "<p>" + "x" * 100_000]
    rows = [(k, f"http://a/{k}", h, "z", 1, 2) for k, h in enumerate(html)]
    rows += [rows[0], rows[0], rows[1], rows[6], (None, "u", html[1], "y", 1, 2), (None, None, "alone", "y", 1, 2), (None, "v", "alone", "y", 1, 2), (2, None, "other " + "y" * 70_000, "z", 3, 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string, id_ int, value int")
    assert Counter(map(tuple, warc.archive_and_read(pages).collect())) == brute_pages(rows)
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    warc.write(pages, str(tmp_path / "w"), str(tmp_path / "s"))
    records = warc.read_records(spark, str(tmp_path / "w")).cache()
    found = {r.page_id: r.payload for r in warc.reassemble(records).where("record_type = 'response' AND page_id <> 2").collect()}
    assert bytes(found[0]) == html[0].encode() and bytes(found[5]) == html[5].encode()
    whole = warc.reassemble(records)
    assert Counter(map(tuple, warc.resolved(whole, str(tmp_path / "r")).collect())) == brute_pages(rows)
    with pytest.raises(Exception, match="response is missing"):
        warc.resolved(whole.where("NOT (record_type = 'response' AND page_id = 1)"), str(tmp_path / "m")).collect()
    for missing in ("segment <> 2", "segment = 1", "segment < 4"):
        with pytest.raises(Exception, match="missing"):
            warc.reassemble(records.where(missing)).collect()


def test_warc_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = [(k, "u", f"<p>{k % 7}") for k in range(40)]
    assert Counter(map(tuple, warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())) == brute_pages(rows)


def test_items_that_share_windows_count_towards_the_broadcast(spark, monkeypatch):
    shared = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(f"item-{k:05d}", shared if k < 300 else f"{shared} w{k}") for k in range(400)], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"a {shared} b"), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    seen = []
    real = decontam._suspects
    monkeypatch.setattr(decontam, "_suspects", lambda *a: seen.append(a[-1]) or real(*a))
    few, many = decontam.scan(docs, benchmark), decontam.scan(docs, benchmark, max_bytes=5_000)
    want = [(1, 12, 10, 400), (2, 3, 0, 0), (3, 0, 0, 0)]
    for found in (few, many):
        assert sorted((r.doc_id, r.n_words, r.n_hit, len(r.items)) for r in found.collect()) == want
    assert seen == [True, False]


def test_sharding_of_odd_names(spark):
    rows = spark.createDataFrame([(1, "x", 5), (None, "y", 6)], ["doc.id", "a `b`.c", "Shard"])
    found = sharding.place(rows, ["a", "b"], 11, key="doc.id")
    assert found.columns == ["doc.id", "a `b`.c", "slot", "shard", "shard_name"] and found.count() == 2


def test_chunked_framing():
    assert warc.dechunk(warc.chunked(b"abc" * 100, 7)) == b"abc" * 100
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")


def test_language_masks_and_counts(spark):
    """Every n-gram that a language was given has its bit, and counts are those of a plain loop."""
    rows = spark.createDataFrame([("the cat sat on the mat again", "en"), ("le chat noir dort ici", "fr"), ("der hund und die katze", "de")] * 3, "text string, lang string")
    model = langid.train(rows, top=40)
    texts = ["the cat and le chat", "hund", "", "zz 12 the"]
    for row, data, offsets in textbytes.slices(pa.array(texts)):
        counts, n = model.counts(data, offsets)
        for k, t in enumerate(texts):
            raw = bytes(langid._CLASS[b] for b in t.encode())
            grams = [raw[i : i + 4] for i in range(len(raw) - 3) if b"  " not in raw[i : i + 3]]
            assert n[k] == len(grams)
            for j in range(len(model.languages)):
                hits = 0
                for g in grams:
                    at = [p[0] for p in langid.positions(np.array([int.from_bytes(g, "little")], np.uint32))]
                    hits += all(int(model.table[0, p]) >> j & 1 for p in at)
                f = model.false_rate[j]
                assert np.isclose(counts[j, k], (hits - len(grams) * f) / (1 - f))
    for j, lang in enumerate(model.languages):
        own = [r.text for r in rows.collect() if r.lang == lang][0].encode()
        at = langid.positions(np.array([int.from_bytes(own[:4], "little")], np.uint32))
        assert all(int(model.table[0, p[0]]) >> j & 1 for p in at)
    dirty = spark.createDataFrame([(f"some text {k} of a label", f"l{k}") for k in range(1500)], "text string, lang string")
    learned = langid.train(dirty, top=5)
    assert len(learned.languages) == 1500 and learned.table.shape[0] == 24


def test_weak_labels_and_scorer_by_plain_loops():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 3, (60, len(quality.LABELLERS)))
    patterns, counts = np.unique((v * 3 ** np.arange(v.shape[1])).sum(1)), None
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    got, rates = quality.expectation_maximisation(patterns, counts, rounds=3)
    votes = [[p // 3**j % 3 for j in range(v.shape[1])] for p in patterns.tolist()]
    good = [0.1 if 2 in x else 0.95 for x in votes]
    for _ in range(3):
        prior = [(sum(c * w for c, w in zip(counts, ws)) + 1) / (sum(counts) + 2) for ws in ([1 - g for g in good], good)]
        rate = [[[0.0] * 3 for _ in range(v.shape[1])] for _ in range(2)]
        for k, ws in enumerate(([1 - g for g in good], good)):
            for x, c, w in zip(votes, counts, ws):
                for j, vote in enumerate(x):
                    rate[k][j][vote] += c * w
        rate = [[[(r + 0.5) / (sum(three) + 1.5) for r in three] for three in one] for one in rate]
        good = []
        for x in votes:
            like = [prior[k] * np.prod([rate[k][j][vote] for j, vote in enumerate(x)]) for k in range(2)]
            good.append(like[1] / sum(like))
    assert np.allclose(got, good) and np.allclose(rates, rate)
    texts = ["abc abc", "x", "", "Some longer text, with marks!"]
    for _, data, offsets in textbytes.slices(pa.array(texts)):
        stats, _n = quality.statistics(data, offsets)
        x = quality.vectors(data, offsets, stats)
        w = rng.normal(size=x.shape[1])
        assert np.allclose(quality.linear_scores(data, offsets, stats, w), 1 / (1 + np.exp(-(x.astype(float) @ w))), atol=1e-6)
        for k, t in enumerate(texts):
            raw, want = t.encode(), Counter()
            for i in range(len(raw) - 2):
                g = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % 2**32
                want[g >> 32 - (quality.BUCKETS.bit_length() - 1)] += quality.TRIGRAM_SCALE / len(raw)
            assert np.allclose(x[k, : quality.BUCKETS], [want[b] for b in range(quality.BUCKETS)], atol=1e-6)


def brute_pipeline(rows, bench, kept):
    """The stages after the classifier, on the rows that it keeps: what near duplicates and decontamination leave."""
    comp = {i: c for i, _, c in brute_join(kept)}
    kept = [r for r in kept if comp[r.doc_id] == r.doc_id]
    return [r for r in kept if not brute_hits(r.text, bench)[1]]


@pytest.mark.parametrize("name", ["documents", "odd", "empty"])
def test_pipeline(request, spark, name):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, tables[-1], SF).cache()
        if k < 4:
            assert out.columns == docs.columns
        tables.append(out)
    tokens = tables[-1].collect()
    assert tables[-1].columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and sum(r.n_tokens for r in tokens) == max((r.start + r.n_tokens for r in tokens), default=0)
    scores = quality.classify(docs)
    assert tables[1].count() == scores.where("keep").count()
    if name == "documents":
        bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        want = brute_pipeline(docs.collect(), bench, tables[1].collect())
        assert Counter(r.doc_id for r in tables[3].collect()) == Counter(r.doc_id for r in want)
        plan = {r.doc_id: r.copies for r in mixing.mix(tables[3]).collect()}
        assert Counter(r.doc_id for r in tables[4].collect()) == Counter({i: c for i, c in plan.items() if c})
        own, texts, start = Tokenizer.from_file(token_planes.default_tokenizer()), sorted((r.doc_id, r.text) for r in tables[4].collect()), 0
        for r, (i, text) in zip(sorted(tokens, key=lambda r: r.start), texts, strict=True):
            ids = np.array([*own.encode(text, add_special_tokens=False).ids, 2], "<u4")
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_columns_of_the_names_used_within(spark):
    names = "doc_id long, text string, source string, id_ int, key int, key_ int, hits int, size__ int, nth_ int, copies int, source_ int, n int, `a.b` int"
    docs = spark.createDataFrame([(k, f"some words of text {k} " + "and more " * 5, "s", *range(10)) for k in range(6)], names)
    bench = spark.createDataFrame([(1, "words of text 3")], "item_id long, text string")
    for out in (decontam.drop_documents(docs, bench), decontam.remove_spans(docs, bench), ngram_join.keep_one(docs), mixing.mix_documents(docs), quality.keep_good(docs)):
        assert out.columns == docs.columns and out.count() <= 20
    assert decontam.drop_documents(docs, bench).count() == 5
