import math
import zlib
from collections import Counter

import numpy as np
from seedloom.llm.lm import pieces_of, score, word_likelihood

TEXTS = ["The cat sat", "the cat ran on the mat", "", None, "unseenword Ωmega the", "a b c d e f", "the the the", "日本語 text here", "cat\tcat\x0bcat", "x" * 40]


def test_lattice_sums_over_all_segmentations():
    p = pieces_of("piece_bpe_32k.model")
    logp = p.start()

    def brute(w):
        if not w:
            return 1.0
        total = 0.0
        for j in range(1, len(w) + 1):
            if w[:j] in p.ids:
                total += math.exp(logp[p.ids[w[:j]]]) * brute(w[j:])
            elif j == 1:
                total += math.exp(logp[-1]) * 256.0 ** -len(w[0].encode()) * brute(w[1:])
        return total

    words = ["the", "cats", "question", "Ωx", "a"]
    ex = np.zeros(len(logp))
    got = word_likelihood(words, p, logp, ex)
    assert np.allclose(got, [math.log(brute("▁" + w)) for w in words])
    sizes = np.zeros(len(logp))
    sizes[list(p.ids.values())] = list(map(len, p.ids))
    sizes[-1] = 1
    assert math.isclose(ex @ sizes, sum(len(w) + 1 for w in words), rel_tol=1e-6)  # each word is covered once


def test_base_and_counts(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], 1, "w") for i in range(40)] + [(None, "no id", 1, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, words string").repartition(3)
    words = {r: (r[1] or "").encode().lower().split() for r in rows}
    held = lambda key: key is not None and zlib.crc32(str(key).encode()) % 7 == 2
    train = [r for r in rows if not held(r[0])]
    c = Counter(w for r in train for w in words[r])
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    want = {}
    for r in rows:
        tokens = [*words[r], None]
        want[r[0]] = (held(r[0]), len(tokens), sum(c[t] > 0 for t in tokens), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens))
    for block in (24_000_000, 30):
        got = score(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)
            assert -1000 < r.score < 0
        by = {r.doc_id: r.score for r in got}
        assert math.isclose(by[0], by[10], rel_tol=1e-9)


def test_no_rows_no_training(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert score(df).count() == 0
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = score(spark.createDataFrame([(key, "only held out")], "doc_id long, text string")).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 4, 0.0) and r.score < 0


def test_scores_against_all_segmentations(spark):
    """The fitted model and the plain lattice, by listing every segmentation of every word."""
    vocab = ["the", "cat", "cats", "at", "ran", "Ωx", "on", "mat", "xy"]
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(vocab[k] for k in rng.integers(0, 4 + i % 6, i % 7).tolist())) for i in range(40)] + [(50, None), (51, "neverseen")]
    p = pieces_of("piece_bpe_32k.model")
    held = lambda key: zlib.crc32(str(key).encode()) % 7 == 2
    words = {k: (t or "").encode().lower().decode().split() for k, t in rows}
    c = Counter(w for k, _ in rows if not held(k) for w in words[k])
    texts = sum(not held(k) for k, _ in rows)
    n = c.total() + texts

    def ways(word, prob):
        """(pieces, probability) of every segmentation of the marked word."""
        found = [((), 1.0, 0)]
        marked, done = "▁" + word, []
        while found:
            own, q, at = found.pop()
            if at == len(marked):
                done.append((own, q))
                continue
            for j in range(at + 1, len(marked) + 1):
                if marked[at:j] in p.ids:
                    piece = p.ids[marked[at:j]]
                    found.append(((*own, piece), q * prob[piece], j))
                elif j == at + 1:
                    found.append(((*own, -1), q * prob[-1] * 256.0 ** -len(marked[at].encode()), j))
        return done

    prob = np.exp(p.start())
    plain = {w: math.log10(sum(q for _, q in ways(w, prob))) for k in words for w in words[k]}
    for _ in range(2):
        uses = np.where(prob > 0, 0.01, 0.0)
        for w in c:
            each = ways(w, prob)
            whole = sum(q for _, q in each)
            for own, q in each:
                for piece in own:
                    uses[piece] += q / whole
        prob = uses / uses.sum()
    once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    model = lambda w: math.log10(max(c[w] - d, 0) / n + d * len(c) / n * sum(q for _, q in ways(w, prob)))
    end = math.log10(texts / n)
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=60).collect()}
    for k, _ in rows:
        assert math.isclose(got[k].score, sum(map(model, words[k])) + end, rel_tol=1e-6)
        assert math.isclose(got[k].lattice_score, sum(plain[w] for w in words[k]) + end, rel_tol=1e-6)


def test_long_texts(spark):
    texts = ["word " * 100_000, "x" * 20_000, "- " * 100_000, " ".join(f"w{i}" for i in range(50_000))]
    got = {r.doc_id: r for r in score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i].n_tokens for i in range(4)] == [100_001, 2, 100_001, 50_001] and all(r.score < 0 and r.lattice_score < 0 for r in got.values())
