"""Every operator on small fixtures: brute force, edge rows, empty tables, clashing columns."""

import collections
import itertools
import glob
import hashlib
import math
import os
import re
import struct
import zlib
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pytest
import xxhash

from hanlens.llm import exact_dedup, language_model, line_dedup, mixing, quality_classifier, quality_rules, queries, sentencepiece_dropout, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, source string, kept string"
LONG = " ".join(f"word{k % 997}" for k in range(30_000)) + "."
EDGE = [
    (1, None, "a", "x"), (2, "", "b", None), (3, " \n\t", None, "x"), (None, "one two three", "", "x"), (5, "ONE two three", "a", "x"),
    (6, "same text here", "a", "x"), (6, "same text here", "a", "x"), (7, LONG, "b", "x"), (8, "same  text\nhere", "a", "x"), (None, None, None, None),
    (9, "漢字 emoji 😀 ▁mark nbsp", "é", "x"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(str, got[order].values.tolist())) == sorted(map(str, want[order].values.tolist()))


def test_columns_that_clash(spark, edge):
    """A row id, a copy number or an output's name that the caller already has stays as it is."""
    own = edge.withColumnsRenamed({"kept": "_hanlens_rid"}).selectExpr("*", "'mine' AS size", "'mine' AS Score", "'mine' AS _copy")
    for out in (exact_dedup.exact_dedup(own), mixing.mix(own)):
        assert out.columns == own.columns and {r.Score for r in out.collect()} == {"mine"}
    labels = spark.createDataFrame([(5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for report in (
        toxicity.toxicity_scores(own, toxicity.learn(own, labels)), language_model.lm_scores(own), quality_rules.quality_report(own),
        quality_classifier.quality_scores(own, quality_classifier.train(own, labels)), substring_dedup.substring_report(own),
    ):
        assert report.count() == len(EDGE) and not any("mine" in map(str, r) for r in report.collect())
    coded = sentencepiece_dropout.encode_docs(own.withColumnRenamed("size", "Lossless"), sentencepiece_dropout.Pieces())
    assert coded.columns[-3:] == ["piece_ids", "n_pieces", "lossless_"] and all(r.lossless_ for r in coded.collect())


def test_exact_dedup_brute_force(edge):
    groups = collections.defaultdict(list)
    for k, (d, t, *_) in enumerate(EDGE):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, k))
    got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup_report(edge).collect())
    want = collections.Counter()
    for content, members in groups.items():
        best = min(members)
        for m in members:
            want[None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, hashlib.sha256(content.encode()).hexdigest()] += 1
    assert got == want
    kept = exact_dedup.exact_dedup(edge)
    assert kept.columns == edge.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(edge.limit(0)).count() == 0


def test_exact_dedup_large_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('a', repeat(' ', int(id % 7)), 'b'), concat('t', id)) AS text").repartition(7)
    got = exact_dedup.exact_dedup_report(docs).where("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {6} and sum(r.kept for r in got) == 1


def test_substring_dedup_brute_force(edge, spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"v{x}" for x in rng.integers(0, 60, n)) for n in (400, 90, 30, 13, 12)]
    rows = [(k, (base[k % 5] if k % 3 else "new " + base[(k + 1) % 5] + f" tail{k} " + base[k % 5][:60]), "s", "x") for k in range(24)]
    docs = spark.createDataFrame(rows + EDGE, SCHEMA)
    every = rows + EDGE
    first = {}
    for d, t, *_ in every:
        w = words(t)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    want = collections.Counter()
    for d, t, *_ in every:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < (math.inf if d is None else d):
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = collections.Counter(map(tuple, substring_dedup.substring_report(docs).collect()))
    assert got == want
    assert any(n for _, _, n, _ in want)
    full = substring_dedup.repeated_words(docs, with_text=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in full)
    intervals = substring_dedup.matched_intervals(docs).collect()
    assert all(r.stop - r.start >= 13 for r in intervals)
    assert sum(r.stop - r.start for r in intervals) == sum(n * k for (_, _, n, _), k in want.items())
    assert substring_dedup.substring_report(docs.limit(0)).count() == 0


def test_fm_index_finds_every_repeat():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = substring_dedup.FmIndex(text, 4, np.arange(len(text)) // 30, 6)
    ends = np.arange(6, 300)
    here, low, high = index.matches(ends, text, 6)
    grams = collections.Counter(tuple(text[e - 6 : e]) for e in range(6, 301))
    sizes = dict(zip(here.tolist(), (high - low).tolist(), strict=True))
    assert {k: n for k, n in ((k, grams[tuple(text[e - 6 : e])]) for k, e in enumerate(ends)) if n > 1} == sizes
    for k, a, b in zip(here.tolist(), low.tolist(), high.tolist(), strict=True):
        held = sorted(p // 30 for p in range(295) if tuple(text[p : p + 6]) == tuple(text[ends[k] - 6 : ends[k]]))
        assert sorted(index.labels[a:b].tolist()) == held


def test_hot_anchor_is_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 200)
    shared = " ".join(f"s{k}" for k in range(15))
    rows = [(k, f"a{k} b{k} {shared} c{k} d{k}") for k in range(60)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 15 if k else 0 for k in range(60)}


def test_line_dedup(spark):
    def page(k, body):
        return (k, "https://a.example/x", f"<html><body><nav><p>Home</p></nav><script>var x='<p>';</script><p>{body}</p><p>Home &amp; more</p></body></html>")

    pages = [page(k, f"text {k}") for k in range(10)] + [(20, None, None), (21, "bad url", ""), (22, "https://b.example", "<p>only</p>"), (22, "https://b.example", "<p>only</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.host): (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_report(df.drop("host")).collect()}
    assert got[3, "a.example"] == (3, 2, hashlib.sha256(b"text 3").hexdigest())
    assert got[20, ""][:2] == (0, 0) and got[22, "b.example"][:2] == (1, 0)
    full = line_dedup.drop_site_lines(df)
    assert full.count() == len(pages) and {r.page.host for r in full.collect()} == {"clash"}
    assert line_dedup.line_dedup_report(df.limit(0)).count() == 0
    body = " ".join(f"w{k}" for k in range(30_000))
    long = [(k, "https://c.example/", f"<p>{body}</p><p>{body} {k}</p>") for k in range(5)]
    got = line_dedup.line_dedup_report(spark.createDataFrame(long, "page_id long, url string, html string")).collect()
    assert all((r.n_lines, r.n_dropped, r.kept_sha256) == (2, 1, hashlib.sha256(f"{body} {r.page_id}".encode()).hexdigest()) for r in got)
    assert [line_dedup.least_pages(r) for r in (0.3, 0.5, 0.25, 0.1)] == [3, 1, 3, 9]


def brute_mix(rows):
    """(doc_id, size, source_size, target, copies) of (doc_id, text, source) rows, by bisection and plain loops."""
    size = [len(words(t)) for _, t, _ in rows]
    of = collections.Counter()
    for (_, _, s), n in zip(rows, size, strict=True):
        of[s] += n
    order = sorted((s for s in of if s is not None), key=str.encode) + [None] * (None in of)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, list(order)
    while open_:
        left = 1.5 * sum(of.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * of[s]]
        target |= {s: 2 * of[s] for s in over} if over else share
        open_ = [s for s in open_ if s not in target]
    copies = {}
    for s in order:
        cells = collections.Counter(n for (_, _, x), n in zip(rows, size, strict=True) if x == s)
        mean = of[s] / sum(cells.values())
        full = target[s] >= 2 * of[s] * (1 - 1e-12)

        def rate(lam, n, mean=mean):
            return min(2.0, math.exp(min(1.0, lam * n / mean))) if mean else 1.0

        low, high = -1e6, math.log(2) * mean / min([n for n in cells if n] or [1])
        full = full or not of[s]
        for _ in range(300):
            lam = (low + high) / 2
            if sum(k * n * rate(lam, n) for n, k in cells.items()) < target[s]:
                low = lam
            else:
                high = lam
        done, got = Decimal(0), {}
        for n in sorted(cells):
            r = 1.0 if not of[s] or not n else 2.0 if full else rate(high, n)
            more = done + Decimal(repr(cells[n] * r))
            got[n] = int(more.quantize(Decimal(1), ROUND_HALF_UP) - done.quantize(Decimal(1), ROUND_HALF_UP))
            done = more
        gap = int(Decimal(repr(target[s])).quantize(Decimal(1), ROUND_HALF_UP)) - sum(n * k for n, k in got.items())
        for n in sorted(cells, reverse=True):
            if n and abs(gap) >= n:
                by = min(2 * cells[n] - got[n], gap // n) if gap > 0 else -min(got[n], -gap // n)
                got[n] += by
                gap -= n * by
        for n in cells:
            def place(k):
                d = rows[k][0]
                return (42 if d is None else xxhash.xxh64_intdigest(struct.pack("<q", d), 42)) % mixing.SLOTS, d is not None, d or 0

            members = sorted((k for k, r in enumerate(rows) if r[2] == s and size[k] == n), key=place)
            for at, k in enumerate(members):
                copies[k] = got[n] // cells[n] + (at < got[n] % cells[n])
    return [(d, size[k], of[s], target[s], copies[k]) for k, (d, _, s) in enumerate(rows)]


def test_mixing_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(k, "w " * int(rng.integers(0, 60)), f"s{k * k % 7}") for k in range(700)] + [(d, t, s) for d, t, s, _ in EDGE] + [(1000 + k, "v " * 9, "s1") for k in range(300)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    show = lambda x: sorted((str(d), n, z, round(t, 6), c) for d, n, z, t, c in x)
    assert show((r.doc_id, r.size, r.source_size, r.target, r.copies) for r in got) == show(brute_mix(rows))
    assert all(r.taken == r.size * r.copies for r in got)


def test_mixing_targets(spark, edge):
    rows = [(k, "w " * (1 + (k * 7) % 40), f"s{k % 5}", "x") for k in range(500)] + EDGE
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 2 * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    want = sorted(round(target[s], 6) for _, _, s, _ in rows)
    assert sorted(round(r.target, 6) for r in got) == want
    taken = collections.Counter()
    for r in got:
        taken[r.source_size, round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    largest = collections.Counter()
    for r in got:
        largest[r.source_size, round(r.target, 6)] = max(largest[r.source_size, round(r.target, 6)], r.size)
    for (z, t), n in taken.items():  # one document of most of a source's words can only be taken whole
        alike = sum(1 for s in sizes if (sizes[s], round(target[s], 6)) == (z, t))
        assert abs(n - t * alike) <= (largest[z, t] if 10 * largest[z, t] > t else max(2, 0.02 * t))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_language_model_counts_and_gain(spark, sf_dir, edge):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = {r.doc_id: r for r in language_model.lm_scores(docs).collect()}
    tokens = {d: [w.lower() for w in words(t)] + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(x for d, ts in tokens.items() if not held[d] for x in ts)
    n, v = sum(c.values()), len(c)
    for d, ts in tokens.items():
        r = out[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ts), sum(x in c for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), rel=1e-9)
    gain = sum(out[d].score - out[d].base_score for d in out if held[d])
    assert gain > 0
    other = {r.doc_id: r for r in language_model.lm_scores(docs.repartition(7)).collect()}
    assert all(other[d].score == pytest.approx(out[d].score, abs=1e-4, rel=1e-6) for d in out)
    odd = language_model.lm_scores(edge).collect()
    assert len(odd) == len(EDGE) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in odd)
    assert language_model.lm_scores(edge.limit(0)).count() == 0


def test_scores_whole(spark, sf_dir, edge):
    """Every score again, word by word: the recursion in plain loops, and each word's share in its class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 60").unionByName(edge.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    learning = docs.where(~language_model.held_out_col("doc_id", 7, 2))
    vocab = language_model.vocabulary(language_model.written(language_model.word_counts(learning), "test"), held.count(False))
    coded = language_model.encode(docs, vocab, 7, 2, "doc_id", "text")
    hmm = language_model.train(language_model.written(coded.where("not held_out"), "test"), vocab.prior)
    c = collections.Counter(w.lower() for (_, t), h in zip(rows, held, strict=True) if not h for w in words(t))
    own = {w: k for k, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language_model.OWN])}
    mass, once = collections.Counter(), collections.Counter()
    for w, n in c.items():
        if w not in own:
            mass[language_model.word_class(w)] += n + 1
            once[language_model.word_class(w)] += n == 1
    kinds = collections.Counter(language_model.word_class(w) for w in c if w not in own)
    want = []
    for d, t in rows:
        a, total = None, 0.0
        for w in [*(x.lower() for x in words(t)), None]:
            q = language_model.END if w is None else own.get(w, -1)
            if q < 0:
                q = language_model.word_class(w)
                unseen = (once[q] + 1) / (mass[q] - kinds[q] + 2)
                total += math.log10((1 - unseen) * (c[w] + 1) / mass[q]) if w in c else math.log10(unseen)
            a = (hmm.start if a is None else [sum(a[i] * hmm.step[i, j] for i in range(language_model.STATES)) for j in range(language_model.STATES)]) * hmm.emit[:, q]
            total, a = total + math.log10(sum(a)), a / sum(a)
        want.append((str(d), total))
    got = sorted((str(r.doc_id), r.score) for r in language_model.lm_scores(docs).collect())
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-6, abs=1e-4)


def test_long_sequences_carry_their_state(monkeypatch):
    rng = np.random.default_rng(8)
    hmm = language_model.uniform_start(np.ones(language_model.SYMBOLS) / language_model.SYMBOLS)
    seq = rng.integers(0, language_model.SYMBOLS, 1000).astype(np.uint16)
    whole = language_model.path(hmm, seq)
    monkeypatch.setattr(language_model, "PIECE", 37)
    assert language_model.path(hmm, seq) == pytest.approx(whole, rel=1e-12)


def test_forward_is_exact():
    rng = np.random.default_rng(6)
    prior = np.ones(language_model.SYMBOLS) / language_model.SYMBOLS
    hmm = language_model.uniform_start(prior)
    seqs = [rng.integers(0, language_model.SYMBOLS, n).astype(np.uint16) for n in (1, 5, 3, 5)]
    laid = language_model._Laid(seqs)
    got = language_model.forward(hmm, laid)[0]
    for k, d in enumerate(laid.order):
        a = hmm.start * hmm.emit[:, seqs[d][0]]
        for s in seqs[d][1:]:
            a = (a @ hmm.step) * hmm.emit[:, s]
        assert got[k] == pytest.approx(math.log10(a.sum()), rel=1e-9)
    counts, fit = language_model.expected(hmm, laid)
    assert fit == pytest.approx(got.sum())
    assert counts.emit.sum() == pytest.approx(14, rel=1e-4) and counts.step.sum() == pytest.approx(10, rel=1e-4)


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(7)
    seqs = [(rng.integers(0, 50, 40) + (100 if k % 2 else 0)).astype(np.uint16) for k in range(60)]
    prior = np.bincount(np.concatenate(seqs), minlength=language_model.SYMBOLS) + 1.0
    prior /= prior.sum()
    hmm, laid, before = language_model.uniform_start(prior), language_model._Laid(seqs), -math.inf
    for _ in range(5):
        now = language_model.forward(hmm, laid)[0].sum()
        assert now > before - 1
        before = now
        hmm = language_model.maximised(language_model.expected(hmm, laid)[0], prior)


def coded(spark, seqs):
    return spark.createDataFrame([(bytearray(s.tobytes()),) for s in seqs], "symbols binary")


def test_every_iteration_reads_all_training_texts(spark, monkeypatch):
    rng, end = np.random.default_rng(9), language_model.END
    seqs = [np.append(rng.integers(0, 40, k % 7), end).astype(np.uint16) for k in range(1000)]
    texts, prior, read = coded(spark, seqs).cache(), np.ones(language_model.SYMBOLS) / language_model.SYMBOLS, []
    one = language_model.baum_welch
    monkeypatch.setattr(language_model, "baum_welch", lambda e, h, p: read.append(e.count()) or one(e, h, p))
    language_model.train(texts, prior)
    assert read and set(read) == {len(seqs)}
    want = collections.Counter((a, b) for s in seqs for a, b in itertools.pairwise([end, *s.tolist()]))
    for frame, tokens in ((texts.repartition(3), language_model.COUNTED_PAIRS), (texts, 50)):
        monkeypatch.setattr(language_model, "COUNTED_PAIRS", tokens)
        got = [x for r in language_model.neighbours(frame).collect() for x in zip(np.frombuffer(r.pair, np.int32).tolist(), np.frombuffer(r.n, np.int64).tolist(), strict=True)]
        assert len(got) == len(want) and {divmod(p, language_model.SYMBOLS): n for p, n in got} == want
    sizes, summed = [], language_model._summed
    monkeypatch.setattr(language_model, "_summed", lambda d, h, f: sizes.append(sum(int(np.frombuffer(r.n, np.int64).sum()) for r in d.collect())) or summed(d, h, f))
    language_model.start(texts, prior)
    assert sizes == [sum(map(len, seqs))] * language_model.START_ITERATIONS


def test_expected_pairs_is_exact():
    rng, end, states = np.random.default_rng(10), language_model.END, range(language_model.STATES)
    hmm = language_model.uniform_start(np.ones(language_model.SYMBOLS) / language_model.SYMBOLS)
    hmm = hmm._replace(start=rng.dirichlet(np.ones(language_model.STATES)))
    left = rng.dirichlet(np.ones(language_model.STATES))
    pairs = {(end, 5): 3, (end, end): 2, (5, 6): 7, (6, 5): 1, (5, end): 4}
    emit, step, begin, fit = np.zeros_like(hmm.emit), np.zeros_like(hmm.step), np.zeros_like(hmm.start), 0.0
    for (a, b), n in pairs.items():
        if a == end:
            p = hmm.start * hmm.emit[:, b]
            begin += n * p / p.sum()
            emit[:, b] += n * p / p.sum()
        else:
            p = np.array([[left[i] * hmm.emit[i, a] * hmm.step[i, j] * hmm.emit[j, b] for j in states] for i in states])
            step += n * p / p.sum()
            emit[:, a] += n * p.sum(axis=1) / p.sum()
            emit[:, b] += n * p.sum(axis=0) / p.sum()
        fit += n * math.log10(p.sum())
    emit[:, end] *= 2
    cells, n = np.array([a * language_model.SYMBOLS + b for a, b in pairs], np.int32), np.array(list(pairs.values()))
    got, likelihood = language_model.expected_pairs(hmm, left, [(cells[:2].tobytes(), n[:2].tobytes()), (cells[2:].tobytes(), n[2:].tobytes())])
    assert likelihood == pytest.approx(fit)
    for x, y in zip(got, (begin, step, emit), strict=True):
        assert np.allclose(x, y, rtol=1e-9, atol=1e-15)


def test_sentencepiece_round_trip(edge):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.MODEL)
    plain, varied = sentencepiece_dropout.Pieces(p=0.0), sentencepiece_dropout.Pieces()
    for _, t, *_ in EDGE:
        if t and "▁" not in t:
            assert plain.encode(t, 1) == sp.encode(t)
        assert varied.decode(varied.encode(t or "", 1)) == (t or "")
    assert varied.encode(LONG, 1) != varied.encode(LONG, 2) and varied.encode(LONG, 1) == sentencepiece_dropout.Pieces().encode(LONG, 1)
    coded = sentencepiece_dropout.encode_docs(edge.withColumnRenamed("kept", "lossless"), varied)
    assert coded.columns == ["doc_id", "text", "source", "lossless", "piece_ids", "n_pieces", "lossless_"]
    assert all(r.lossless_ for r in coded.collect())
    back = sentencepiece_dropout.decode_docs(coded, varied).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert sentencepiece_dropout.encode_docs(edge.limit(0), varied).count() == 0


def test_sentencepiece_draws_for_each_occurrence():
    varied, plain = sentencepiece_dropout.Pieces(), sentencepiece_dropout.Pieces(p=0.0)
    word = "understanding"
    docs = varied.encode_many([word] * 4000, list(range(4000)))
    ways = collections.Counter(map(tuple, docs))
    assert len(ways) > 8 and tuple(plain.encode(word, 1)) in ways and all(varied.decode(w) == word for w in ways)
    # What a worker remembers changes nothing: heap, table and tree draw alike.
    assert docs == [varied._code(" " + word, int(varied._keys(k, 0, 1)[0]))[0] for k in range(4000)]
    assert docs[3999] == sentencepiece_dropout.Pieces().encode(word, 3999)
    assert len({tuple(varied.encode_many([LONG], [1], [c])[0]) for c in (0, 1)}) == 2


def labelled(spark, bad, good, label):
    rows = [(k, (bad if k % 2 else good)(k), "s", "x") for k in range(400)]
    return spark.createDataFrame(rows + EDGE, SCHEMA), spark.createDataFrame([(k, int((k % 2 == 1) == (label == "toxic"))) for k in range(400)], f"doc_id long, {label} int")


def test_toxicity_learns_and_folds(spark):
    docs, labels = labelled(spark, lambda k: f"this w{k} is vile{k % 9}ness talk {'v1le9x' if k % 4 == 1 else 'vileword'}", lambda k: f"this w{k} is a fine day number {k}", "toxic")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).where("doc_id >= 100").collect()}
    assert all(r.predicted == d % 2 for d, r in got.items())
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(docs, model).collect())
    m = toxicity.Matcher(toxicity.Toxicity((("clown", True, 2.0), ("vile", False, 1.0)), ("clown fish",), 0.0, 1.0, 0.0))
    assert [h[:2] for h in m.hits("a cl0wn, сlown clowns clown fish vïleness 10 anvile")] == [(2, 7), (9, 14), (33, 37)]
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.toxicity_scores(docs, none).collect()} == {0}
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0
    assert toxicity.toxic_spans(docs, model).count() > 0


def naive_hits(text, entries, exceptions):
    """What ``Matcher.hits`` must find, by trying every place."""
    low = toxicity.plain(text)
    folded = toxicity.fold(low)
    best, safe = {}, []
    for s in range(len(low)):
        if s and low[s - 1].isalnum():
            continue
        for term, whole, weight in entries:
            e = s + len(term)
            if folded.startswith(term, s) and not (whole and low[e : e + 1].isalnum()) and any(x.isalpha() for x in low[s:e]) and weight > best.get(s, (0, 0.0))[1]:
                best[s] = (e, weight)
        for phrase in exceptions:
            p = toxicity.fold(toxicity.plain(phrase))
            if folded.startswith(p, s):
                safe.append((s, s + len(p)))
    return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and e <= b for a, b in safe)]


def test_matcher_equals_brute_force():
    rng = np.random.default_rng(2)
    entries = (("vile", False, 1.0), ("vil", False, 0.5), ("clown", True, 2.0), ("scum", True, 1.5), ("sc", False, 0.1), ("vileness", True, 3.0))
    exceptions = ("clown fish", "scum line", "a vile")
    parts = ["clown", "cl0wn", "сlоwn", "ＶＩＬＥ", "vileness", "v1le", "scum", "5cum", "$cum", "fish", "line", "a", " ", " ", " ", ", ", "10", "​", "é", "x", "\n"]
    m = toxicity.Matcher(toxicity.Toxicity(entries, exceptions, 0.0, 1.0, 0.5))
    for _ in range(1500):
        text = "".join(rng.choice(parts, 12))
        assert m.hits(text) == naive_hits(text, entries, exceptions), text


def test_toxicity_keeps_words_that_share_rows(spark):
    bad = [f"x{k} vileword y{k * 7} {'scumword' if k % 2 else 'z'} q{k}" for k in range(60)] + [f"z{k} scumword u{k * 3} t{k}" for k in range(3)]
    copied = [" ".join(f"c{j}" for j in range(60)) + f" vileword passenger e{k}" for k in range(12)]
    rows = list(enumerate(bad + copied + [f"a{k} calm day b{k * 5} n{k}" for k in range(300)], 1000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000 + len(bad + copied))) for i, _ in rows], "doc_id long, toxic int")
    entries = {(t, whole) for t, whole, _ in toxicity.learn(docs, labels).entries}
    assert {("vileword", True), ("scumword", True)} <= entries
    assert not any("passenger".startswith(t) for t, _ in entries)
    assert not any(not whole and "scumword".startswith(t) for t, whole in entries)


def test_quality_classifier(spark):
    docs, labels = labelled(spark, lambda k: f"buy | now | w{k} | $$$ | cheap | click", lambda k: f"a calm sentence number w{k}, which ends well.", "quality")
    model = quality_classifier.train(docs, labels)
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, model).where("doc_id >= 100").collect()}
    assert all(r.predicted == 1 - d % 2 for d, r in got.items())
    assert got[100].held_out == (zlib.crc32(b"100") % 5 == 0)
    kept = quality_classifier.quality_filter(docs, model)
    assert kept.columns == docs.columns
    empty = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.quality_scores(docs, empty).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), model).count() == 0


def plain_ftrl(rows, alpha=0.5, beta=1.0, l1=0.02, l2=0.2, seed=8):
    """Follow-the-regularised-leader, a coordinate at a time; the bias is coordinate None."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    ones = sum(y for *_, y in rows)
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}

    def w(i):
        a, b = (0.0, 0.0) if i is None else (l1, l2)
        return 0.0 if abs(z[i]) <= a else -(z[i] - math.copysign(a, z[i])) / ((beta + math.sqrt(n[i])) / alpha + b)

    rng = np.random.default_rng(seed)
    for _ in range(quality_classifier.EPOCHS):
        for k in rng.permutation(len(rows)):
            index, value, y = rows[k]
            x = [*zip(index.tolist(), value.tolist(), strict=True), (None, 1.0)]
            now = {i: w(i) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(now[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * weight[y] * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * now[i]
                n[i] += g * g
    return w


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    made = [" ".join(f"t{x}" for x in rng.integers(0, 40, 25) + 20 * (k % 2)) + "!" * (k % 3) for k in range(120)]
    rows = [(*quality_classifier.features(t), k % 2) for k, t in enumerate(made)]
    model, w = quality_classifier.fit_ftrl(rows), plain_ftrl(rows)
    assert model.bias == pytest.approx(w(None), abs=1e-9)
    for index, *_ in rows:
        assert [model.weights[i] for i in index] == pytest.approx([w(i) for i in index.tolist()], abs=1e-9)
    for t in made[:10]:
        tokens = re.findall(r"\w+|[^\w\s]+", t.lower())
        h = [zlib.crc32(x.encode()) for x in tokens]
        h = [h[0], *(quality_classifier._REP if b == a else b for a, b in zip(h, h[1:], strict=False))]
        mult, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
        both = [x * mult & mask for x in h] + [(a * mult + b) * 0xC2B2AE3D27D4EB4F & mask for a, b in zip(h, h[1:], strict=False)]
        n = collections.Counter(x >> 64 - quality_classifier.BITS for x in both)
        norm = math.sqrt(sum(math.log1p(k) ** 2 for k in n.values()))
        dot = sum(w(i) * math.log1p(k) / norm for i, k in n.items()) + w(None)
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-9)


def test_quality_rules(spark, edge):
    clean = "A clean sentence with some words, and more of them. " * 12
    rows = [(50, clean, "s", "x"), (51, clean + "\n" + "home | about | news | shop | help\n" * 60, "s", "x"), (52, "go go go " * 40, "s", "x")]
    docs = spark.createDataFrame(rows + EDGE, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.quality_report(docs).collect()}
    assert got[51].kept is False and got[52].base_failed and got[52].n_repeat_words == 120
    assert got[1].n_words == 0 and got[1].base_failed
    assert got[9].word_chars == len("漢字emoji😀▁mark nbsp")
    cleaned = quality_rules.quality_clean(docs)
    assert cleaned.columns == docs.columns
    kept = {r.doc_id for r in got.values() if r.kept}
    assert {r.doc_id for r in cleaned.collect()} == kept
    varied = " ".join(f"Some word{k}, then more{k}." for k in range(30))
    lines = (varied + "\nhome | about | news | shop\n\nThe end of it.").split("\n")
    one = quality_rules.quality_clean(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert one.text == "\n".join(x for x in lines if "|" not in x)
    for _, t, *_ in rows + EDGE:
        w = words(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        assert quality_rules.repeat_words(w) == len(covered)
    assert quality_rules.quality_report(docs.limit(0)).count() == 0
