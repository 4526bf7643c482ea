import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from effectlake.llm import chat_format, hard_negatives, periodic_runs
from effectlake.llm.queries import CONTROLS

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, part int, piece string, tie string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def turns(spark):
    texts = [None, "", " ", "\\", "\\\\<s>\\", "[INST", "INST]", "[[INST]]", "<</SYS>> [ROLE] x [:] y [/ROLE]\n", CONTROLS, "é\n 🙂 </s>\n<s> ", "x" * 70_000 + "[/INST]", "[INST] a [/INST]\n<s> b </s>\n"]
    roles = ["user", "assistant", "system", "tool", None, "", "[:]", "a [:] b", "Assistant", "<s>"]
    random.seed(3)
    rows = [(random.choice([0, 1, 2, -5, None]), random.choice([0, 1, 2, 3, 40, None]), random.choice(roles), random.choice(texts), 1, "x", "y") for _ in range(400)]
    rows += [(7, k, "assistant" if k % 2 else "user", f"turn {k} " + random.choice(texts[2:]), 1, "x", "y") for k in range(600)] + rows[:9]
    return spark.createDataFrame(rows, TURNS).repartition(5).cache()


def in_order(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r.conv_id].append(r)
    key = lambda r: (r.turn is not None, r.turn or 0, r.tie_)
    return {c: [(r.role or "", r.text or "") for r in sorted(own, key=key)] for c, own in convs.items()}


@pytest.mark.parametrize("piece", [60, 5_000, chat_format.PIECE])
def test_chats_read_back(spark, turns, tmp_path, piece):
    convs = in_order(turns.withColumn("tie_", F.xxhash64("role", "text")).collect())
    pieces = chat_format.format_chats(turns, str(tmp_path / "chats"), piece)
    found = {r.conv_id: r for r in chat_format.read_back(pieces).collect()}
    assert found.keys() == convs.keys()
    for c, said in convs.items():
        learned = "".join(t for r, t in said if r == "assistant")
        want = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned))
        assert tuple(found[c])[1:5] == want, c
    texts = defaultdict(str)
    for r in sorted(pieces.collect(), key=lambda r: (r.part, r.piece)):
        texts[r.conv_id] += bytes(r.text).decode()
        for a, b in zip(r.loss_starts, r.loss_ends, strict=True):
            assert not any(m in bytes(r.text)[a:b] for m in chat_format.MARKS)
    assert all(len(texts[c]) == found[c].formatted_chars for c in convs)
    if piece == 60:
        assert pieces.where("conv_id = 7").count() > 50


def test_chats_escape_no_more_than_marks():
    text = "a\\b<s></s>[/INST] <b> [x]"
    out, offsets, lo, hi = chat_format.assemble(*(chat_format.pa.array([x]) for x in ("user", text)))
    assert bytes(out).decode() == "[INST] a\\\\b<\\s><\\/s>[\\/INST] <b> [x] [/INST]\n" and offsets.tolist() == [0, len(out)]
    assert chat_format.parse(bytes(out)) == [(b"user", text.encode(), int(lo[0]), int(hi[0]))]
    with pytest.raises(ValueError):
        chat_format.parse(b"[INST] no end")


def test_chats_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.read_back(chat_format.format_chats(none, str(tmp_path / "chats"))).count() == 0


def brute_runs(words, most_words=6):
    n, seen, out = len(words), set(), []
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            j = i
            while same[j]:
                j += 1
            if j - i >= 3 * q and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= most_words:
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_report(doc_id, text, plant=True):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000]
    found = {r.doc_id: tuple(r) for r in periodic_runs.report(periodic_runs.detect(periodic_runs.with_planted_repeats(docs))).collect()}
    assert len(found) == docs.count() and sum(r[1] for r in found.values()) > 10
    for r in rows:
        assert found[r.doc_id] == brute_report(r.doc_id, r.text)


def test_periodic_runs_of_strings():
    random.seed(5)
    for _ in range(60):
        docs = []
        for _ in range(random.randint(1, 6)):
            n, letters = random.randint(0, 500), random.choice([1, 2, 3, 50])
            w = [random.randrange(letters) for _ in range(n)]
            for _ in range(random.randint(0, 4) if n > 8 else 0):
                p, a = random.randint(1, n // 4), random.randrange(n)
                for i in range(a + p, min(n, a + random.randint(p, 6 * p))):
                    w[i] = w[i - p]
            docs.append(w)
        bounds = np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])))
        w = np.concatenate([np.array([*d, 1000 + k], np.int64) for k, d in enumerate(docs)])
        got = sorted(zip(*(x.tolist() for x in periodic_runs.runs_of(w, bounds)), strict=True))
        assert got == sorted((s + int(bounds[k]), s + n + int(bounds[k]), q) for k, d in enumerate(docs) for s, n, q in brute_runs(d, 0))


def test_synchronising_sets_are_consistent_and_dense():
    random.seed(8)
    part = [random.randrange(4) for _ in range(300)]
    w, t = np.array([*part, 9, 9, 8, *part]), 16
    names = np.array([hash(tuple(w[i : i + t])) % 2**63 for i in range(len(w) - t + 1)], np.uint64)
    chosen = set(periodic_runs.synchronising_set(names, t, np.zeros(len(names), bool)).tolist())
    assert all((i in chosen) == (i + 303 in chosen) for i in range(300 - 2 * t))
    assert all(chosen & set(range(i, i + t)) for i in range(len(w) - 3 * t)) and len(chosen) < len(w) / 4


def test_periodic_runs_of_odd_texts(spark):
    long = " ".join(["a b c"] * 40_000 + [f"w{k % 5003}" for k in range(30_000)])
    texts = [None, "", " \n", "x", "a a a a a a", "a\x0ba\x0ca\ta\ra\na", "           ", "a b a b a b a b", "a b a b a b a", "A a A a A a A a", "\x1c a \x1c a \x1c a \x1c a", long]
    rows = [(k, t, 3, "x", 1) for k, t in enumerate(texts)] + [(None, "z " * 30, 3, "x", 1), (5, "z " * 30, 3, "x", 1), (5, "z " * 30, 3, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, strongest string, n_words int")
    found = sorted((tuple(r) for r in periodic_runs.report(periodic_runs.detect(docs)).collect()), key=str)
    short = [brute_report(r[0], r[1], plant=False) for r in rows if r[1] is not long]
    left = [r for r in found if r[0] != 11]
    assert left == sorted(short, key=str)
    runs = periodic_runs.detect(docs.where("doc_id = 11")).first()
    assert [tuple(r) for r in runs.runs] == [(0, 120_000, 3), (120_000, 30_000, 5003)] and runs.n_words == 150_000
    assert periodic_runs.detect(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.detect(docs, least_exponent=3)


def brute_negatives(rows):
    """rows: vec_id -> (label, vector), complete ones only."""
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(2**63)), 2**63 - 1)
    out = []
    for a in (i for i in rows if i % 100 == 0):
        all_ = sorted((-score(rows[a][1], v), i, label) for i, (label, v) in rows.items() if i != a)
        for p, i, _ in [x for x in all_ if x[2] == rows[a][0]][:5]:
            hits = [(j, -s) for s, j, label in all_ if label != rows[a][0] and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, i, k + 1, j, -p, s) for k, (j, s) in enumerate(hits)]
    return sorted(out)


VECTORS = "vec_id long, label int, vector array<long>, code string, block int"


def vectors_of(kind, n=2_000):
    g = np.random.default_rng(11)
    dims = {"plain": 64, "odd": 70, "one": 1, "ties": 3}[kind]
    centres = g.normal(0, 60, (4, dims))
    label = np.where(g.random(n) < 0.4, 0, g.integers(0, 4, n))
    v = (centres[label] + g.normal(0, 40, (n, dims))).astype(int)
    return [(i, int(label[i]), (v[i] if kind != "ties" else np.sign(v[i])).tolist(), "x", 1) for i in range(n)]


@pytest.mark.parametrize("kind", ["plain", "odd", "one", "ties"])
def test_hard_negatives(spark, kind, monkeypatch):
    if kind == "odd":
        monkeypatch.setattr(hard_negatives, "BLOCK", 4)
        monkeypatch.setattr(hard_negatives, "PART", 300)
    rows = vectors_of(kind)
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0).collect()
    want = brute_negatives({r[0]: (r[1], r[2]) for r in rows})
    assert sorted(tuple(r) for r in found) == want and len(want) > 100


def test_hard_negatives_of_odd_rows(spark):
    rows = vectors_of("plain", 300)
    rows += [(None, 1, [1, 2], "x", 1), (400, None, [1], "x", 1), (401, 1, None, "x", 1), (500, 1, [1, None], "x", 1), (600, 2, [], "x", 1), (700, 1, [7] * 40, "x", 1), rows[0], (5, 9, [5] * 64, "x", 1)]
    rows += [(800, 1, [2**62, 2**61, 9], "x", 1), (801, 1, [2**62, 2**62, 3], "x", 1), (802, 3, [2**40] * 64, "x", 1), (803, 2, [-(2**63)] * 3, "x", 1)]
    known = {}
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and None not in v:
            known[i] = min(known.get(i, (label, v)), (label, v))
    frame = spark.createDataFrame(rows, VECTORS)
    found = sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 100 == 0).collect())
    assert found == brute_negatives(known)
    assert hard_negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_intervals_hold_the_products_and_leave_rows_out():
    g = np.random.default_rng(2)
    v = g.integers(-300, 300, (3_000, 64))
    x = hard_negatives.rotated(v.astype(float))
    assert np.allclose((x**2).sum(1), (v.astype(float) ** 2).sum(1))
    code = hard_negatives.packed(x >= 0)
    align, size = np.abs(x).sum(1) / 8, np.sqrt((x**2).sum(1))
    residual = np.sqrt(size**2 - align**2)
    a = v[0] + g.integers(-100, 100, 64)
    anchor = hard_negatives.Anchor(a, hard_negatives.rotated(a[None].astype(float))[0])
    low, high = anchor.bounds(code, np.bitwise_count(code).sum(1, dtype=np.int64), align, residual, size)
    exact = v @ a
    assert ((low <= exact) & (exact <= high)).all() and np.median(high - low) < 2 * np.median(size) * anchor.size
    assert (high < exact[0]).mean() > 0.5
