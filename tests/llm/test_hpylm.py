import math
import zlib
from collections import Counter

import numpy as np

from tests.llm.helpers import edge_docs, edge_rows, no_docs, odd_docs, odd_ids, prose
from wayfold.llm.hpylm import OPEN, Contexts, WordModel, add_up, block_pairs, blocks, draw_contexts, known_words, meet, sample_spelling, score, states, stirling, tables
from wayfold.llm.hpylm import VALUES, _counted, _floats, _unpack, _unpack_words


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_counts_and_base_are_exact(spark):
    rows = [(i, prose(i, 60), None) for i in range(60)] + [(100, None, None), (101, "", None)]
    got = {r.doc_id: r for r in score(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()}
    c = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, _ in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-6)


def test_edges(spark):
    assert score(edge_docs(spark)).count() == len(edge_rows())
    assert score(no_docs(spark)).count() == 0
    odd = score(odd_docs(spark)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in odd), key=str) == sorted(((i, len(tokens(t))) for i, t in odd_ids()), key=str)
    lonely = spark.createDataFrame([(i, "only held out") for i in range(40) if held(i)], "doc_id long, text string")
    rows = score(lonely).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 for r in rows)


def test_tables_follow_the_seating_process():
    """Expected tables against a simulation of the conditional distribution by brute force over partitions."""
    d, x = 0.6, 1.7
    for c in (2, 3, 4, 5):
        weights = Counter()

        def seat(sizes, p, left, weights=weights):
            if not left:
                weights[len(sizes)] += p * x ** len(sizes)
                return
            for k in range(len(sizes)):
                seat(sizes[:k] + [sizes[k] + 1] + sizes[k + 1 :], p * (sizes[k] - d), left - 1)
            seat([*sizes, 1], p, left - 1)

        seat([], 1.0, c)
        want = sum(t * w for t, w in weights.items()) / sum(weights.values())
        assert math.isclose(tables(np.array([float(c)]), np.array([x]), d, stirling(d), None)[0], want, rel_tol=1e-9)
    drawn = tables(np.full(20_000, 5.0), np.full(20_000, x), d, stirling(d), np.random.default_rng(0))
    assert abs(drawn.mean() - want) < 0.03
    uniform = np.random.default_rng(1).random((4, 20_000))
    added = tables(np.full(20_000, 5.0), np.full(20_000, x), d, stirling(d), None, uniform)
    assert abs(added.mean() / 4 - want) < 0.03
    many = tables(np.array([10_000.0]), np.array([5.0]), d, stirling(d), None)[0]
    assert 5 * np.log(10_000 / 5) * 0.8 < many < 5 * np.log(10_000 / 5) * 1.3


def test_spelling_and_words_sum_to_one():
    words = [b"ab", b"aba", b"b", b"", b"cab"]
    keys, counts = Counter(), None
    for w in words:
        s = [256, 256, *w, 256]
        for i in range(2, len(s)):
            keys[(s[i - 2] * 257 + s[i - 1]) * 257 + s[i]] += 2
    k = np.array(sorted(keys))
    counts = np.array([keys[x] for x in k], dtype=float)
    spelling = sample_spelling(k, counts)
    p = np.power(10.0, spelling.log10_p.astype(float))
    seen = int(spelling.place.max())
    unseen = 257 - seen
    assert np.allclose(p[:, :, :seen].sum(axis=2) + unseen * p[:, :, seen], 1, atol=1e-4)
    c = np.array([5.0, 1.0, 2.0, 7.0, 1.0])
    model = WordModel(16, 5, 6.0, 0.5, 1.0, spelling)
    t = tables(c, model.pull(spelling.score(words)), 0.5, model.log_s, None)
    model.tables = float(t.sum())
    model.spelled = float(np.power(10.0, spelling.score(words)).sum())
    for _ in range(50):  # tables and what they pull settle
        model.tables = float(tables(c, model.pull(spelling.score(words)), 0.5, model.log_s, None).sum())
    total = np.power(10.0, model.log10(words, c)).sum() + 10 ** model.log10_unknown()
    assert math.isclose(total, 1, abs_tol=1e-3)


def test_held_out_text_is_more_likely_than_under_the_base(spark):
    rows = [(i, prose(i, 150) + f" w{i} v{i * 3}") for i in range(120)]
    got = [r for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


class OneEach(Contexts):
    """A table for every customer."""

    def seat(self, c, pull, rng):
        return c.astype(float)


def test_pairs_and_their_tables_against_brute_force(spark):
    """Counts of pairs over several blocks, and the sums of their tables by word, against counting in Python."""
    rows = [(i, prose(i, 40) + f" w{i % 5}" if i % 11 else None) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = blocks(docs, 7, 2, tokens=300).cache()
    met = meet(cut, 8).cache()
    pairs, words = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            words.update(tokens(t))
            pairs.update(zip([b"", *tokens(t)], tokens(t), strict=False))
    found = met.toArrow()
    assert sum(found.column("ones").to_pylist()) == sum(c == 1 for c in pairs.values())
    assert sum(found.column("twos").to_pylist()) == sum(c == 2 for c in pairs.values())
    all_blocks = cut.toArrow().to_pylist()
    assert len(all_blocks) > 4
    contexts = OneEach(sum(words.values()), len(words), 0.6, 1.0)
    owners = Counter()
    for b in all_blocks:
        spelled = _unpack_words(b["words"])
        p = block_pairs(_unpack(b["places"]), np.array(b["n_tokens"]), spelled)
        mine = found.filter(pc_equal(found, b["block"]))
        c_word, (c, owned) = _counted(mine, 0)[0], _counted(mine, 1)
        assert [words[w] for w in spelled] == c_word.tolist()
        assert [pairs[spelled[u], spelled[w]] for u, w in zip(p.before, p.now, strict=True)] == c.tolist()
        for u, w, own in zip(p.before, p.now, owned, strict=True):
            owners[spelled[u], spelled[w]] += own
    assert set(owners.values()) == {1}
    # The sums are those of the pairs' counts.
    state = states(cut, met, 8, 8)
    added = add_up(draw_contexts(state, spark.createDataFrame([], VALUES), contexts, 0, 8), met, 8).cache()
    rows = added.toArrow()
    want = Counter()
    for (u, _), n in pairs.items():
        want[u] += n
    for b in all_blocks:
        open_ = _floats(rows.filter(pc_equal(rows, b["block"])), OPEN)
        assert open_.tolist() == [want[w] for w in _unpack_words(b["words"])]
    served = {w: n for r in known_words(met, added).collect() for w, n in zip(_unpack_words(r["words"]), _unpack(r["values"], "<u8").tolist(), strict=True)}
    assert served == {w: words[w] for w in served} and set(words) <= set(served)


def pc_equal(table, block):
    import pyarrow.compute as pc

    return pc.equal(table.column("block"), block)



def seat_by_seat(pairs, base, d, d_word, sweeps, seed):
    """The same two levels with every customer at a table of its own record, moved one by one: averaged predictive
    probabilities of (before, now). ``base``: the probability of each word below the word restaurant."""
    rng = np.random.default_rng(seed)
    rest = {u: {} for u, _ in pairs}  # restaurant: dish: sizes of its tables
    word: dict = {}  # dish: sizes of its tables, whose customers are the tables above

    def p_word(w):
        n, t = sum(map(sum, word.values())), sum(map(len, word.values()))
        return (sum(word.get(w, [])) - d_word * len(word.get(w, [])) + (1 + d_word * t) * base[w]) / (1 + n)

    def put(sizes, dd, new):
        weights = np.array([*(k - dd for k in sizes), new])
        k = rng.choice(len(weights), p=weights / weights.sum())
        if k < len(sizes):
            sizes[k] += 1
            return False
        sizes.append(1)
        return True

    def take(sizes):
        k = rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def p_pair(u, w):
        mine = rest.get(u, {})
        n, t = sum(map(sum, mine.values())), sum(map(len, mine.values()))
        return (sum(mine.get(w, [])) - d * len(mine.get(w, [])) + (1 + d * t) * p_word(w)) / (1 + n)

    def enter(u, w):
        t = sum(map(len, rest[u].values()))
        if put(rest[u].setdefault(w, []), d, (1 + d * t) * p_word(w)):
            tw = sum(map(len, word.values()))
            put(word.setdefault(w, []), d_word, (1 + d_word * tw) * base[w])

    for u, w in pairs:
        enter(u, w)
    total = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            if take(rest[u][w]):
                take(word[w])
            enter(u, w)
        if sweep >= sweeps // 4:
            for pair in set(pairs):
                total[pair] += p_pair(*pair)
    return {k: v / (sweeps - sweeps // 4) for k, v in total.items()}


def test_sweeps_agree_with_an_exact_sampler():
    """Alternate draws of whole restaurants, as ``score`` makes them, against customers that are moved one by one."""
    r = np.random.default_rng(3)
    words = ["a", "b", "c", "d", "e"]
    pairs = [(words[min(int(r.exponential(1.2)), 4)], words[min(int(r.exponential(1.5)), 4)]) for _ in range(160)]
    base = dict(zip(words, (0.2, 0.2, 0.15, 0.15, 0.1), strict=True))
    d, d_word = 0.6, 0.5
    want = seat_by_seat(pairs, base, d, d_word, 500, 1)
    counts = Counter(pairs)
    keys = sorted(counts)
    c = np.array([counts[k] for k in keys])
    before, now = (np.array([words.index(k[i]) for k in keys]) for i in (0, 1))
    c_before = np.bincount(before, weights=c, minlength=5)
    h = np.array([base[w] for w in words])
    contexts, log_s = Contexts(len(pairs), 5, d, 1.0), stirling(d_word)
    open_, p = contexts.first_open(c_before), np.maximum(np.bincount(now, weights=c, minlength=5), 1) / len(pairs)
    t_word, total, rng = np.ones(5), np.zeros(len(keys)), np.random.default_rng(2)
    for sweep in range(400):
        t = contexts.seat(c, contexts.pull(open_[before], p[now]), rng)
        open_, served = np.bincount(before, weights=t, minlength=5), np.bincount(now, weights=t, minlength=5)
        x = (1 + d_word * t_word.sum()) * h
        t_word = tables(served, x, d_word, log_s, rng)
        x = (1 + d_word * t_word.sum()) * h
        p = (np.maximum(served - d_word * tables(served, x, d_word, log_s, None), 0) + x) / (1 + served.sum())
        if sweep >= 100:
            total += contexts.predictive(c, c_before[before], open_[before], p[now]) / 300
    got = dict(zip(keys, total, strict=True))
    assert max(abs(math.log10(got[k] / want[k])) for k in keys) < 0.04
    assert abs(sum(counts[k] * math.log10(got[k] / want[k]) for k in keys)) / len(pairs) < 0.01


def test_texts_of_one_word_are_a_distribution_with_the_longer_ones(spark):
    """The empty text, the vocabulary's texts of one word and an unknown one together have less than all probability."""
    learned = [(i, prose(i, 3) if i % 2 else prose(i, 1)) for i in range(120) if not held(i)]
    words = sorted({w for _, t in learned for w in tokens(t)})
    texts = [w.decode() for w in words] + ["neverseen"]
    asked = [i for i in range(1000, 9000) if held(i)][: len(texts)]
    rows = score(spark.createDataFrame(learned + list(zip(asked, texts, strict=True)), "doc_id long, text string")).collect()
    total = sum(10**r.score for r in rows if r.doc_id >= 1000)
    share = sum(len(t.split()) <= 1 for _, t in learned) / len(learned)
    assert 0.7 * share < total < 1


def test_only_tables_that_the_end_needs_are_left(spark, monkeypatch):
    from wayfold.plans import scratch

    monkeypatch.setattr(scratch, "_written", [])
    rows = score(spark.createDataFrame([(i, prose(i, 20)) for i in range(12)], "doc_id long, text string"))
    left = Counter(path.rsplit("/", 1)[1].split("-")[0] for _, path in scratch._written)
    assert left == {"states": 1, "values": 3}
    assert rows.count() == 12
