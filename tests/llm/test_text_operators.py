"""Each operator against a plain brute-force version, over hand-made and awkward documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.llm import decontamination, lm_scoring, near_dedup, packing, pii, quality_classifier, quality_rules, secrets, sharding, warc_revisits
from geoloom.llm.common import materialize
from geoloom.llm.textstats import stats

WORDS = [w for w in "the cat sat on a mat and ate some fish while dogs ran over green hills near old rivers".split()]


def prose(seed, n):
    return " ".join(WORDS[(seed * 31 + k * k * 7 + k * seed) % len(WORDS)] for k in range(n))


HEX = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
TEXTS = [
    None, "", " \n\t ", "one", prose(1, 120), prose(1, 120), prose(1, 119) + " end", prose(2, 400), "ITEM " + prose(9, 14) + " tail", prose(3, 60).upper() + "!!",
    f'token = "{HEX}" mail joe@ex.org 10.0.0.255 4111 1111 1111 1111 +1 (714) 555-9345', "é ü " * 50 + "ß", "x" * 40_000, prose(4, 30_000), "a\n" * 30, "## $$ ** " * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward texts, a repeated row, a row without doc_id, and columns whose names operators use inside."""
    rows = [(k, t, "en", 7, "z") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", 7, "z"), (None, prose(8, 70), None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, n long, shard string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def low(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low(text)) if w]


def by_row(df):
    return sorted(map(tuple, df.collect()), key=repr)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


SECRETS = [("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def base_secrets(text):
    least = {"access": 18, "hex": 16}
    return [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(SECRETS) for m in re.finditer(p, text) if (len(m[2]) >= 12 if name == "assign" else len(m[0]) >= least[name])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="tokenTOKEN=:'\" AKIA019af_kſ\n", max_size=80))
def test_base_secrets_match_plain_patterns(text):
    assert [(a, secrets.KINDS[k], b) for a, k, b in secrets.base_spans(text)] == [(a, n, b) for a, _, n, b in sorted(base_secrets(text))]


def test_secret_scan(docs, empty):
    got = by_row(secrets.scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"))
    want = []
    for r in docs.collect():
        spans = base_secrets(r.text or "")
        n = Counter(s[2] for s in spans)
        want.append((r.doc_id, n["assign"], n["access"], n["hex"], digest(spans)))
    assert got == sorted(want, key=repr)
    assert secrets.scan_secrets(empty).count() == 0


def test_literals_are_scored_by_name_and_constants_propagate():
    spans = lambda t: [t[a:b] for a, _, b, *_ in secrets.scan_text(t)[1]]
    assert spans('db_pwd: "hunter2-Xk9!"') == ["hunter2-Xk9!"]
    assert spans("K = 'Zx81$kqP02!m'\nOTHER = K\nclient_credentials = OTHER") == ["Zx81$kqP02!m"]
    assert spans('page_title = "Zx81$kqP02!m"') == [] and spans('db_pwd = "changeme"') == [] and spans("the key: a word") == []


def test_redaction_leaves_nothing_to_find(docs):
    out = secrets.redact_secrets(docs.withColumn("n_chars", F.length("text")))
    assert out.columns == [*docs.columns, "n_chars"] and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert HEX not in rows[10].text and "joe@ex.org" in rows[10].text and rows[10].n_chars == len(rows[10].text)
    assert rows[0].text is None and rows[7].text == TEXTS[7]


def brute_decontamination(texts, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = {}
    for item, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(item)
    out = []
    for doc_id, text in texts:
        w, hit, found = cut(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= g
        ids = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, empty):
    items = [(1, "Item. " + prose(9, 14).upper()), (2, "x" * 40_000), (10, prose(1, 30)), (3, None), (4, " ! "), (10, "é ü É"), (11, "é ü é"), (5, "not in any document at all, really not")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_decontamination([(r.doc_id, r.text) for r in docs.collect()], [(i, t) for i, t in items])
    assert by_row(decontamination.decontaminate(docs, bench, proximity=False)) == sorted(want, key=repr)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r[0] for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert not decontamination.decontaminate(docs, bench.where("false")).where("contaminated").count()


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "blue and red or green"), (2, "red green blue"), (3, "red green")], "doc_id long, text string")
    rows = {r.doc_id: (r.n_items, r.n_near_items) for r in decontamination.decontaminate(docs, bench).collect()}
    assert rows == {1: (0, 1), 2: (1, 1), 3: (0, 0)}


def brute_near_items(texts, items, window=10):
    """n_near_items of each document, from plain lists of positions."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    docs = [(i, cut(t)) for i, t in texts]
    n = Counter(w for _, ws in docs for w in ws)
    out = []
    for i, ws in docs:
        found = set()
        for item, text in items:
            g = cut(text)
            for k in range(max(1, len(g) - window + 1) if g else 0):
                terms = set(g[k : k + window])
                if all(n[t] for t in terms):
                    rarest = min(terms, key=lambda t: (n[t], t.encode()))
                    if any(terms <= set(ws[max(0, p - window + 1) : p + window]) for p, w in enumerate(ws) if w == rarest):
                        found.add(item)
        out.append((i, len(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [decontamination.BROADCAST_BYTES, 0])
def test_index_with_and_without_broadcast(spark, docs, monkeypatch, most):
    """Exact and proximity matches equal brute force, also where no table of the benchmark may be broadcast and terms are heavy."""
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", most)
    shuffled = prose(9, 14).split()
    shuffled[3:9] = reversed(shuffled[3:9])
    items = [(1, prose(9, 14)), (2, " ".join(shuffled)), (3, "one"), (4, "the the the cat"), (5, prose(4, 25)), (6, "one two")]
    texts = [*((r.doc_id, r.text) for r in docs.collect()), *((100 + k, f"{prose(k, 30)} {prose(9, 14)} {k}") for k in range(40))]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    rows = decontamination.decontaminate(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_near_items) for r in rows), key=repr) == brute_near_items(texts, items)
    assert sorted(map(tuple, (r[:6] for r in rows)), key=repr) == sorted(brute_decontamination(texts, items), key=repr)


def test_quality_rules(docs, empty):
    rows = quality_rules.judge(docs).collect()
    for r in rows:
        text = next(t for t in (x.text or "" for x in docs.where(F.col("doc_id").eqNullSafe(r.doc_id)).collect()))
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert len(rows) == docs.count() and quality_rules.judge(empty).count() == 0


def brute_em(votes):
    """EM over single documents, in plain Python; (quality of each document, rates)."""
    n, m = len(votes), len(votes[0])
    rates = [[list(quality_rules.EXPECTED[c]) for c in (0, 1)] for _ in range(m)]
    good = 0.85
    for _ in range(500):
        post = []
        for v in votes:
            fit = [math.log(1 - good), math.log(good)]
            for r, x in enumerate(v):
                for c in (0, 1):
                    fit[c] += math.log(rates[r][c][x + 1])
            post.append(1 / (1 + math.exp(min(500, fit[0] - fit[1]))))
        good = (sum(post) + quality_rules.PRIOR * n / 2) / (n * (1 + quality_rules.PRIOR))
        new = [[[quality_rules.PRIOR * n * e for e in quality_rules.EXPECTED[c]] for c in (0, 1)] for _ in range(m)]
        for v, p in zip(votes, post, strict=True):
            for r, x in enumerate(v):
                new[r][0][x + 1] += 1 - p
                new[r][1][x + 1] += p
        rates, old = [[[y / sum(c) for y in c] for c in r] for r in new], rates
        if max(abs(a - b) for r, s in zip(rates, old, strict=True) for c, d in zip(r, s, strict=True) for a, b in zip(c, d, strict=True)) < 1e-9:
            break
    return post, rates


def test_quality_and_kept_equal_em_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = list(quality_rules.rules())
    rows = quality_rules.judge(docs).collect()
    table = [[r.pattern // 3**k % 3 - 1 for k in range(len(names))] for r in rows]
    post, _ = brute_em(table)
    assert [r.quality for r in rows] == pytest.approx(post, abs=1e-6)
    assert [r.kept for r in rows] == [not r.base_failed and p >= 0.5 for r, p in zip(rows, post, strict=True)]
    assert any(r.kept for r in rows) and not all(r.kept or r.base_failed for r in rows)


def test_em_weighs_rules_by_their_accuracy():
    """Votes drawn from known rates: EM finds them, and accurate good votes outweigh several bad votes of poor rules."""
    import numpy as np

    rng = np.random.default_rng(5)
    poor, sharp = [[0.4, 0.2, 0.4], [0.25, 0.2, 0.55]], [[0.8, 0.1, 0.1], [0.01, 0.09, 0.9]]
    true = np.array([poor, poor, poor, sharp, sharp, sharp])
    good = rng.random(40_000) < 0.7
    votes = np.stack([[-1, 0, 1][0] + (rng.random(len(good))[:, None] > np.cumsum(r[good.astype(int)], 1)[:, :2]).sum(1) for r in true], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    rates, prior, post = quality_rules.fit_em(patterns, counts.astype(float))
    share = np.array([0.3, 0.7])[:, None]
    want = (share * true + quality_rules.PRIOR * np.array(quality_rules.EXPECTED)) / (share + quality_rules.PRIOR)  # what the prior's weight makes of the true rates
    assert np.abs(rates - want).max() < 0.05 and abs(prior - 0.7) < 0.05
    of = {tuple(p): q for p, q in zip(patterns.tolist(), post, strict=True)}
    assert of[-1, -1, -1, 1, 1, 1] > 0.9 and of[1, 1, 1, -1, -1, -1] < 0.1 and of[1, 1, 1, -1, -1, 1] < 0.5


def test_lm_scores(docs, empty):
    rows = lm_scoring.score(docs, classes=4).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = [(r.doc_id, [*words_of(r.text), None]) for r in docs.collect()]
    c = Counter(w for i, ws in texts if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in texts)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and r.perplexity > 1 for r in rows) and lm_scoring.score(empty).count() == 0


def test_lm_joins_rare_words(docs, monkeypatch):
    """Which words travel with the tasks and where a task starts afresh changes nothing."""
    result = lambda: sorted((repr(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_scoring.score(docs, classes=4).collect())
    monkeypatch.setattr(lm_scoring, "UNITS", 5)
    whole = result()
    for name, value in (("HEAD", 3), ("HELD_HEAD", 1), ("NEIGHBOUR_WORDS", 4), ("TASK_WORDS", 3)):
        monkeypatch.setattr(lm_scoring, name, value)
    assert result() == whole


def test_lm_splits_each_text_once(docs):
    """The passes after the first read ids of words, not texts."""
    read = docs.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seen = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
    assert lm_scoring.score(seen, classes=4).count() == docs.count() == read.value


def test_lm_blocks_of_ids_hold_whole_texts():
    import numpy as np
    import pyarrow as pa

    texts = [np.arange(n, dtype=np.int64) + 100 * n for n in (1, 5, 2, 2, 9, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in texts], pa.binary())], names=["words"])
    for parts in ([batch], [batch.slice(0, 2), batch.slice(2, 0), batch.slice(2)], [batch.slice(k, 1) for k in range(7)]):
        for most in (1, 3, 4, 100):
            got = list(lm_scoring.blocks(iter(parts), most))
            assert np.concatenate(got).tolist() == np.concatenate(texts).tolist()
            assert all(len(b) <= most + 9 and b[0] % 100 == 0 for b in got)  # a text's ids start at a hundred
            rows = [(r.column("words").to_pylist(), ids.tolist(), np.diff(stops, prepend=0).tolist()) for r, ids, stops in lm_scoring.pieces(iter(parts), most)]
            assert all(b"".join(w) == np.array(i, np.int64).tobytes() and [len(x) // 8 for x in w] == n for w, i, n in rows)


def brute_lm_scores(texts, n_units, k):
    """(doc_id, score): the class model word by word over lists; texts: (doc_id, in training, words with the end)."""
    import numpy as np

    number = {w: lm_scoring.word_id(w.encode() if w else b"") for _, _, ws in texts for w in ws}
    shape = {w: number[w] & 63 for w in number}
    train = [ws for _, t, ws in texts if t]
    c = Counter(w for ws in train for w in ws)
    units = sorted(sorted(c, key=lambda w: (w is not None, -c[w], number[w]))[:n_units], key=number.get)
    unit = {w: units.index(w) if w in units else n_units + shape[w] for w in number}
    pairs = [(a, b) for ws in train for a, b in zip([None, *ws], ws, strict=False)]
    bigrams = np.zeros((n_units + 64, n_units + 64))
    for a, b in pairs:
        bigrams[unit[a], unit[b]] += 1
    cls = [int(x) for x in lm_scoring.exchange(bigrams, k)]
    seed = {w: cls[unit[w]] for w in number}
    table = [[1.0 + sum(seed[a] == x and seed[b] == y for a, b in pairs) for y in range(k)] for x in range(k)]
    total, column = sum(map(sum, table)), [sum(r[y] for r in table) for y in range(k)]
    before = lambda p, x: math.log(table[p][x] / sum(table[p])) - math.log(column[x] / total)
    after = lambda x, q: math.log(table[x][q] / sum(table[x]))
    stream = [w for ws in train for w in ws]  # texts follow one another: after an end comes the next text's first word
    of, profile = {}, {}
    for kind in range(64):
        own = [(a, b) for a, b in pairs if unit[b] == n_units + kind]
        follow = [b for a, b in pairs if unit[a] == n_units + kind]
        profile[kind] = [(sum(before(seed[a], x) for a, _ in own) + sum(after(x, seed[b]) for b in follow)) / max(len(own), 1) for x in range(k)]
    for w in number:
        if w in units or not c[w]:
            of[w] = seed[w]
            continue
        value = [sum(before(seed[a], x) for a, b in pairs if b == w) + sum(after(x, seed[b]) for a, b in pairs if a == w) + lm_scoring.PRIOR * profile[shape[w]][x] for x in range(k)]
        of[w] = max(range(k), key=lambda x: round(value[x], 9))
    moves = Counter((of[a], of[b]) for a, b in pairs)
    types, mass = Counter(of[w] for w in c), Counter(of[w] for w in stream)
    out = []
    for i, _, ws in texts:
        logs = 0.0
        for a, b in zip([None, *ws], ws, strict=False):
            x, y = of[a], of[b]
            logs += math.log10((moves[x, y] + 1) / (sum(moves[x, z] for z in range(k)) + k)) + math.log10((c[b] + 1) / (mass[y] + types[y] + 1))
        out.append((repr(i), round(logs, 4)))
    return sorted(out)


@pytest.mark.parametrize("n_units, k", [(5, 3), (12, 4)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, n_units, k):
    monkeypatch.setattr(lm_scoring, "UNITS", n_units)
    monkeypatch.setattr(lm_scoring, "HEAD", 6)
    words = "a river ran by the old hill, while some cats sat on a mat. then dogs ate fish; grün war das tal".split()
    texts = [(i, " ".join(words[(i * 7 + j * j + i * j) % len(words)] + ("x" * (j % 3) if i % 4 == 1 else "") for j in range(3 + i % 9))) for i in range(40)] + [(40, None), (41, " "), (41, " ")]
    rows = lm_scoring.score(spark.createDataFrame(texts, "doc_id long, text string"), classes=k).collect()
    want = brute_lm_scores([(i, zlib.crc32(str(i).encode()) % 7 != 2, [*words_of(t), None]) for i, t in texts], n_units, k)
    assert sorted((repr(r.doc_id), round(r.score, 4)) for r in rows) == want


def test_exchange_stops_where_no_move_helps():
    import numpy as np

    def information(bigrams, cls, k):
        one = np.eye(k)[cls]
        t = one.T @ bigrams @ one
        t = t / t.sum()
        free = t.sum(1, keepdims=True) * t.sum(0, keepdims=True)
        return float((t[t > 0] * np.log(t[t > 0] / free[t > 0])).sum())

    bigrams = np.random.default_rng(5).poisson(2, (14, 14)).astype(float)
    cls = lm_scoring.exchange(bigrams, 4, sweeps=50)
    best = information(bigrams, cls, 4)
    for u in range(14):
        for x in range(4):
            other = cls.copy()
            other[u] = x
            assert information(bigrams, other, 4) <= best + 1e-9


def test_exchange_finds_alternating_classes():
    import numpy as np

    a = np.zeros((6, 6))
    a[:3, 3:], a[3:, :3] = 10, 10
    cls = lm_scoring.exchange(a + np.arange(36).reshape(6, 6) / 1000, 2)
    assert len(set(cls[:3])) == len(set(cls[3:])) == 1 and cls[0] != cls[3]


def test_warc_revisits(spark):
    H = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://www.Ex.org/a/?b=2&a=1&utm_source=x#f", 10, "response", '"v1"', None, "d1", H(age="0", content_type="t", expires="x")),
        (2, "https://ex.org/a?a=1&b=2", 20, "revisit", 'W/"v1"', None, None, H(age="9", content_type="bad")),
        (3, "ex.org/a?a=1&b=2", 9000, "response", '"v2"', None, "d2", None),
        (4, "ex.org/a?a=1&b=2", 9001, "revisit", '"v1"', None, None, None),
        (5, "ex.org/a?a=1&b=2", 20_000, "revisit", None, None, "d2", H(etag="e")),
        (6, "ex.org/never", 5, "revisit", None, None, None, None), (7, None, 30, "revisit", None, None, None, None), (8, "ex.org/a?a=1&b=2", 10, "revisit", None, None, None, None), (9, "ex.org/a?a=1&b=2", None, "revisit", None, None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.record_id: (r.state, r.source_id, r.headers) for r in warc_revisits.resolve(records).collect()}
    assert got[2] == ("resolved", 1, {"age": "9", "content-type": "t", "expires": "x"})
    assert got[4][:2] == ("changed", None) and got[5] == ("resolved", 3, {"etag": "e"})
    assert {got[k][0] for k in (6, 7, 8, 9)} == {"missing"} and len(got) == 7
    assert warc_revisits.resolve(records.where("false")).count() == 0


def test_quality_classifier(spark, docs, empty):
    many = [(k, prose(k, 100 + k)) for k in range(60)] + [(100 + k, " | ".join(prose(k, 60 + k).split())) for k in range(60)]
    texts = spark.createDataFrame(many, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 100), 0) for k, _ in many] + [(999, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    rows = quality_classifier.score(texts, labels, usable=learn).collect()
    assert all(r.predicted == int(r.doc_id < 100) and 0 <= r.score <= 1 for r in rows) and len(rows) == 120
    assert quality_classifier.score(docs, labels).count() == docs.count() and quality_classifier.score(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.score(docs, labels.where("false")).collect()} == {0.5}


def brute_components(texts, width, least=80):
    sets = {}
    for i, t in texts:
        w = words_of(t)
        sets.setdefault(i, set()).update({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates(spark, empty):
    base = prose(5, 90).split()
    texts = [(1, None), (2, " "), (3, "a b"), (4, "A  b"), (5, "a b c")]
    texts += [(10 + k, " ".join([*base[: 80 - 3 * k], *(f"w{j}" for j in range(3 * k)), *base[80:]])) for k in range(12)]  # a chain of edits
    texts += [(50 + k, " ".join(f"u{(k * 7 + j * 3) % 40}" for j in range(30)) + " " + " ".join(base[:60])) for k in range(30)]  # a shared passage
    texts += [(200 + k, prose(6, 200)) for k in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"rep": F.lit(1), "v": F.lit("x")})
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 4).collect()}
    assert rows == brute_components(texts, 4)
    kept = near_dedup.drop_near_duplicates(docs, 4)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in rows.items() if i == c) and kept.columns == docs.columns
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_awkward_rows(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[4] == got[5] == got[6] == 4 and got[0] == 0 and got[1] == 1 and got[None] is None
    assert near_dedup.drop_near_duplicates(docs).count() == len({c for c in got.values()})


def test_near_duplicates_without_ids_or_with_several_texts(spark):
    a, b, c, d = ([f"{x}{j}" for j in range(80)] for x in "abcd")
    near = lambda w: " ".join([*w[:79], "end"])
    a, b, c, d = map(" ".join, (a, b, c, d))
    texts = [(None, a), (None, b), (None, b), (None, near(b.split())), (3, a), (4, near(a.split())), (7, c), (7, d), (7, d), (6, near(d.split())), (9, d), (8, near(c.split()))]
    texts += [(None, ""), (None, ""), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    of = {a: 3, near(a.split()): 3, b: None, near(b.split()): None, c: 7, near(c.split()): 7, d: 6, near(d.split()): 6}
    found = near_dedup.near_duplicates(docs, 4).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((i, of.get(t, i)) for i, t in texts)
    kept = near_dedup.drop_near_duplicates(docs, 4)
    assert kept.columns == docs.columns
    rows = kept.collect()
    real = sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None)
    assert real == sorted([(3, a), (7, c), (6, near(d.split())), (5, "")])
    none = [r.text for r in rows if r.doc_id is None]
    assert len(none) == 4 and none.count("") == 2 and none.count(None) == 1 and {b, near(b.split())} & set(none)


def test_components_of_a_long_path(spark):
    from geoloom.operators.components import components

    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(k, 0) for k in range(301)} | {(1000, 1000), (1001, 1000)}


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        own = sorted({(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[r.doc_id]})
        assert own == [(a, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x)), len(ids)) for a in range(0, len(ids), 4096) for x in [ids[a : a + 4096]]]
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(1 for r in rows if r.doc_id == 4) == 2 and packing.pack(empty).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    e = packing.Encoder(packing.default_tokenizer())
    texts = [x.encode() for x in ("Hello, world. it's", "<|endoftext|> x", "İstanbul É É ǅ", "a.,b ,. 12.5 .", "naïve, mot. ﬁn", "a b c\x1cd", "")]
    assert e.encode(texts) == [e.whole(x) for x in texts] == e.encode(texts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_plan_places_every_piece_once(histogram):
    rows = packing.plan(histogram, 64)
    ranks, fill, n = Counter(), Counter(), 0
    for length, first, times, each, sequence, offset in rows:
        assert first == ranks[length]
        ranks[length] += times
        for k in range(times):
            fill[sequence + k // each] += length
            assert offset + (k % each + 1) * length <= 64
    assert ranks == Counter(histogram) and max(fill.values(), default=0) <= 64
    n = sum(k * v for k, v in histogram.items())
    assert len(fill) <= n // 32 + 1


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_pii(text):
    def luhn(d):
        v = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return sum(x - 9 * (x > 9) for x in v) % 10 == 0

    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(PII) for m in re.finditer(p, text) if fine(name, m[0])]


def test_pii(spark, docs, empty):
    more = ["a@b.co_x@y.z a@b c@d.e.f..g", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 1.2.3.256", "4111 1111-1111 1111 4111111111111111 0000000000000000000000000", "+1 (555)-(22222 +4 12 +123456789012345678 + 1 +1((((((", "é@ü.com xé4111 1111 1111 1111\U0001f600 x@y.zz", "call (714) 555-9345 now", "1" * 3000]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string"))
    rows = pii.find_pii(all_docs)
    want = []
    for r in all_docs.collect():
        spans = base_pii(r.text or "")
        n = Counter(s[2] for s in spans)
        want.append((r.doc_id, n["email"], n["ip"], n["card"], n["phone"], digest(spans)))
    assert by_row(rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == sorted(want, key=repr)
    assert pii.find_pii(empty).count() == 0


def test_pii_adds_what_the_base_rules_miss(spark):
    """Planted data beyond the base patterns is found, decoys are not; the model only ever saw labels of the base rules."""
    word, texts, want = prose(3, 12), [], {}
    for k in range(600):
        a, b, c = 200 + k % 700, 200 + k * 7 % 700, 1000 + k * 37 % 9000
        kind, lead = k % 6, ("call me at", "my phone is", "tel.")[k % 3]
        plus, loose = f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}"
        bad_card = f"{4000 + k} 1234 5678 {1000 + k}"
        body = [f"{lead} {plus}", f"{lead} {loose}", f"made on 2024-01-{10 + k % 18} at noon", f"order {bad_card} of the shop", f"part no. X{c}{a}{b}Y is old", f"mail joe{k}@ex.org or joe{k} (at) ex (dot) org"][kind]
        text = f"{word} {body}. {word}"
        texts.append((k, text))
        want[k] = {1: {loose}, 5: {f"joe{k} (at) ex (dot) org"}}.get(kind, set())
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    text_of = dict(texts)
    found = {r.doc_id: {text_of[r.doc_id][f.start : f.end] for f in r.findings if f.kind in ("number", "address")} for r in pii.find_pii(docs).collect()}
    hits = sum(len(found[k] & want[k]) for k in want)
    assert hits >= 0.95 * sum(map(len, want.values())) and hits >= 0.95 * sum(map(len, found.values()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=4, max_size=4))
def test_flow_moves_the_fewest_bytes(sizes):
    room = sharding.equal_capacities(sum(sizes), 4)
    flow = sharding.min_cost_flow(sizes, room)
    assert [sum(r) for r in flow] == sizes and [sum(c) for c in zip(*flow, strict=True)] == room
    assert sum(flow[i][i] for i in range(4)) == sum(map(min, sizes, room))


def test_resharding(spark, docs, empty):
    many = docs.select("doc_id", "text").unionByName(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.lit("y"), (F.col("id") % 97).cast("int"))).alias("text")))
    rows = sharding.reshard(many.where("doc_id <> 13 and doc_id <> 12")).collect()
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    assert max(sizes.values()) - min(sizes.values()) <= 400
    r = next(r for r in sharding.reshard(docs).collect() if r.doc_id == 0)
    assert (r.size, r.text_crc32, r.law, r.grown_shard) == (1, 0, "bytes", None)
    assert sharding.reshard(docs).count() == docs.count() and sharding.reshard(empty).count() == 0


def test_rewrite(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("q"), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    plan = sharding.reshard(docs, 4, old_shard=F.when(F.col("doc_id") < 300, 0).otherwise(1))
    left = {r.shard for r in sharding.rewrite(docs, plan, str(tmp_path / "x")).collect()}
    out = spark.read.parquet(str(tmp_path / "x"))
    assert out.count() == plan.where(~F.col("shard").isin(*left) if left else F.lit(True)).count()


def test_rewrite_of_null_and_repeated_rows_in_place(spark, tmp_path):
    path = str(tmp_path / "live")
    rows = [(k, "q" * (k % 50 + 1), 0) for k in range(200)] + [(k, "q" * 25, 1) for k in range(200, 260)]
    rows += [(None, f"text {k}", 0) for k in range(20)] + [(None, None, 0)] * 3 + [(7, "again " * 9, k % 2) for k in range(40)] + [(900, "left alone", 2)] * 5 + [(500, "gone", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lies int").withColumn("row", F.monotonically_increasing_id())
    docs.withColumn("shard", F.col("lies")).withColumn("slot", F.lit(-1).cast("long")).write.partitionBy("shard").parquet(path)
    plan = sharding.reshard(docs, 2, old_shard=F.when(F.col("lies") == 2, 0).otherwise(F.col("lies")))
    live = spark.read.parquet(path).where("lies <> 2")
    plan = materialize(plan.where("doc_id is null or doc_id <> 900"), "test-plan")
    sharding.rewrite(live, plan, path, F.col("lies"))
    out = spark.read.parquet(path).collect()
    assert sorted(r.row for r in out) == sorted(r.row for r in docs.collect())
    assert sum(r.shard == 2 for r in out) == 5 and not any(r.shard == 5 for r in out)
    facts = lambda rs: Counter((r.doc_id, r.shard, r.slot) for r in rs if r.shard != 2)
    assert facts(out) == facts(plan.collect())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab c\n|#É \t", max_size=60))
def test_stats_count_as_python_does(text):
    got = stats(text.encode())
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    assert got[0] == len(words) and got[1] == sum(map(len, words)) and got[2] == len(re.findall(r"[#*$%&|<>]", text))
