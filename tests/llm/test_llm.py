"""The training-data operators: against SQL, brute force, libraries and held-out rows, and on awkward tables."""

import collections
import functools
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from conftest import SF, same_rows

from lociform.llm import jaccard_join as J
from lociform.llm import lm_scoring as L
from lociform.llm import queries as llm
from lociform.llm import toxicity as TX
from lociform.llm.common import table
from lociform.llm.decontamination import decontaminate
from lociform.llm.language_id import language_id
from lociform.llm.mixing import mix
from lociform.llm.quality_classifier import LABELLERS, LabelModel, quality_classifier, votes
from lociform.llm.quality_rules import quality_rules
from lociform.llm.token_counts import token_counts
from lociform.llm import url_filters as U
from lociform.llm.url_filters import UrlRule, url_filter

ROW = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words long, size long, body__ string, score double"


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing extra columns."""
    long = "word " * 60_000 + "end"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, long, "en", "b"), (5, "you are an idiot, said the clown", "en", "b"), (5, "you are an idiot, said the clown", "en", "b"), (None, "one two three four five six", None, None), (6, "one two three four five six", "de", "c"), (7, "ONE two  three four five six", "de", "c"), (8, "a ▁ b  c ", "fr", None), (9, "12 34 !!", "es", "c")]
    return spark.createDataFrame([(i, t, x, s, 0, "k", 1, 1, "b", 0.5) for i, t, x, s in rows], ROW)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_decontamination"])
def test_equals_sql(spark, duck, name):
    same_rows(llm.queries()[name](spark, SF), duck.execute(llm.oracle_sql()[name]).df())


def test_awkward_tables(spark):
    docs, labels = awkward(spark), spark.createDataFrame([(5, 1, 1), (4, 1, 0), (None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    runs = [
        lambda d: quality_rules(d), lambda d: language_id(d), lambda d: token_counts(d, public_tokenizers.path("piece_bpe_32k.model")), lambda d: L.lm_score(d), lambda d: decontaminate(d, bench),
        lambda d: TX.toxicity(d, labels), lambda d: quality_classifier(d), lambda d: mix(d), lambda d: J.jaccard_join(d),
    ]
    for run in runs:
        assert run(docs).count() == 11
        assert run(docs.limit(0)).count() == 0
        assert all(r is not None for r in run(docs.drop("score")).collect())


def test_quality_nulls(spark):
    got = by_id(quality_rules(awkward(spark)))
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[4]["n_words"] == 60_001 and got[4]["base_failed"]


def test_language_held_out(spark):
    rows = llm.op2_language_id(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.93 * len(rows)


def test_tokens_equal_the_library(spark):
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for docs in (awkward(spark), table(spark, SF, "documents")):
        want = {r["doc_id"]: len(coder.encode(r["text"] or "")) for r in docs.select("doc_id", "text").collect()}
        for common, most_bytes in ((1_000_000, 64), (50, 64), (1_000_000, 3), (0, 64)):  # all pre-tokens where the text is, some, short ones, none
            got = token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), common=common, common_bytes=most_bytes).collect()
            assert len(got) == docs.count() and all(r["n_tokens"] == want[r["doc_id"]] for r in got)


def test_urls(spark):
    urls = ["http://A.net/x", "https://www.example.net/en/1", "https://example.net/fr/", "ftp://example.com/de/x?y", "http://x.org/fr/", "http://org/frx", "nothing", None, "http://foonet/", "http://x.de/a?b=1&c=2#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[8][2] is None
    assert all(v[3] in ("allow", "block") for v in got.values()) and url_filter(pages.limit(0)).count() == 0


def test_lm_base_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.select("doc_id", "text").collect()}
    c = collections.Counter(w for k, own in words.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in own)
    n, v = sum(c.values()), len(c)
    for r in L.lm_score(docs, common_words=500).collect():
        own = words[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(c[w] > 0 for w in own) and r["train_tokens"] == n and r["score"] < 0
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)


def weighted_tree(learned, scored, depth):
    """log10 probabilities by the definition of context-tree weighting: a dictionary of nodes, and a recursion over them."""
    counts, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def decisions(text):
        data = bytes([10]) * depth + b" ".join(text) + bytes([10])
        for i in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - depth : i], node, bit
                node = 2 * node + bit

    for text in learned:
        for context, node, bit in decisions(text):
            for d in range(depth + 1):
                own = context[depth - d :]
                counts[own, node][bit] += 1
                if d:
                    children[own[1:], node].add(own)

    def log_kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    @functools.cache
    def whole(context, node):
        own = log_kt(*counts[context, node])
        if len(context) == depth:
            return own
        return np.logaddexp(own, sum(whole(c, node) for c in children[context, node])) - math.log(2)

    def one(context, node, d):
        own = context[depth - d :]
        if (own, node) not in counts:
            return 0.5
        z, o = counts[own, node]
        estimate = (o + 0.5) / (z + o + 1)
        if d == depth:
            return estimate
        stay = math.exp(log_kt(z, o) - math.log(2) - whole(own, node))
        return stay * estimate + (1 - stay) * one(context, node, d + 1)

    chance = functools.cache(lambda context, node: one(context, node, 0))
    return [sum(math.log10(chance(c, n) if bit else 1 - chance(c, n)) for c, n, bit in decisions(t)) for t in scored]


@pytest.mark.parametrize(("depth", "common"), [(4, 1_000_000), (4, 300), (2, 50), (1, 1_000_000)])
def test_lm_equals_context_tree_weighting(spark, depth, common):
    draw = np.random.default_rng(5)
    texts = ["".join(draw.choice(list("abcdefghijklm nopqrst"), 400)) for _ in range(14)] + ["the cat sat on the mat"] * 3 + ["Öl und ßtraße", "abab abab", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [L.words_of((t or "").encode()) for t in texts]
    want = weighted_tree([w for k, w in enumerate(own) if zlib.crc32(str(k).encode()) % 5 != 1], own, depth)
    got = by_id(L.lm_score(docs, depth=depth, common_grams=common, common_words=20))
    assert all(got[k]["score"] == pytest.approx(want[k], rel=1e-7) for k in range(len(texts)))


def test_lm_counts_beyond_floats():
    """Counts above 2^24 and 2^53 are kept whole until their logarithms are taken."""
    big = (1 << 24) + 3
    gram = np.array([(97 << 8) | 98, (97 << 8) | 99])
    twigs = L.Twigs(gram, np.array([big, 3]), 1, 0)
    _, zeros, ones, _ = twigs.top
    assert {int(x) for x in (zeros + ones)} >= {big + 3} and int(ones.min()) >= 0
    assert np.allclose(L.log_gamma(np.array([0.5, 1, 3.5, 20])), [math.lgamma(x) for x in (0.5, 1, 3.5, 20)])


def test_lm_tells_learned_documents_apart(spark):
    """Texts that the model has learned, twice the more so, cost less than new ones of the same kind."""
    draw = np.random.default_rng(8)
    texts = [" ".join("".join(draw.choice(list("abcdefghijklmnop"), 5)) for _ in range(60)) for _ in range(60)]
    learned = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 != 1]
    for n, k in enumerate(learned[:10]):
        texts.append(texts[k])
        assert n + 60 == len(texts) - 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(L.lm_score(docs))
    twice = [k for n, k in enumerate(learned[:10]) if zlib.crc32(str(60 + n).encode()) % 5 != 1]
    once, new = [k for k in learned[10:]], [k for k in range(60) if k not in learned]
    mean = lambda ks: np.mean([got[k]["bits_per_byte"] for k in ks])
    assert mean(twice) < mean(once) - 0.2 < mean(new) - 0.4
    assert max(got[k]["bits_per_byte"] for k in twice) < min(got[k]["bits_per_byte"] for k in once)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = llm.op7_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out and toxic is not null").collect()
    bad, good = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in bad) > 0.88 * len(bad) and sum(r["predicted"] for r in good) < 0.05 * len(good)


def test_weak_labels(spark):
    sure, doubt = "++++++++++", "+--+--++++"
    model = LabelModel({sure: 900, doubt: 90, "+0++++++++": 10})
    assert model.posterior(sure) > 0.9 > 0.1 > model.posterior(doubt) and all(0 <= a <= 1 for a in model.accuracies().values())
    sf = "/root/testdata/sf0.01"
    rows = quality_classifier(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").filter("quality is not null").collect()
    bad, good = [r for r in rows if not r["quality"]], [r for r in rows if r["quality"]]
    assert sum(not r["kept"] for r in bad) > 0.9 * len(bad) and sum(r["kept"] for r in good) > 0.9 * len(good)


def test_label_model_equals_plain_expectation_maximisation():
    draw = np.random.default_rng(1)
    patterns = collections.Counter("".join(draw.choice(list("+0-"), len(LABELLERS), p=p)) for p in [(0.7, 0.2, 0.1)] * 300 + [(0.2, 0.3, 0.5)] * 200)
    model = LabelModel(patterns, rounds=40)
    good = {p: 1 / (1 + math.exp(-(p.count("+") - 4 * p.count("-")))) for p in patterns}
    for _ in range(40):
        total = sum(patterns.values())
        share = (sum(n * good[p] for p, n in patterns.items()) + 1) / (total + 2)
        chance = []
        for side in (lambda p: good[p], lambda p: 1 - good[p]):
            mass = sum(n * side(p) for p, n in patterns.items())
            chance.append([{v: (sum(n * side(p) for p, n in patterns.items() if p[k] == v) + 0.1) / (mass + 0.3) for v in "+0-"} for k in range(len(LABELLERS))])
        new = {}
        for p in patterns:
            a, b = (math.prod(c[k][v] for k, v in enumerate(p)) for c in chance)
            new[p] = share * a / (share * a + (1 - share) * b)
        good = new
    assert all(model.posterior(p) == pytest.approx(good[p], abs=1e-6) for p in patterns)


def test_texts_of_a_repeated_key_have_their_own_votes(spark):
    draw = np.random.default_rng(6)
    fine = lambda: " ".join(("the ", "and ", "of ", "in ")[k % 4] + "".join(draw.choice(list("abcdefghij"), 5)) + ("," if k % 9 == 0 else "") for k in range(40))
    rows = [(1, fine()) for _ in range(60)] + [(1, "!!! ### $$$ " * 30 + str(i)) for i in range(60)]
    got = quality_classifier(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["kept"], "-" in r["votes"]) for r in got) == {(True, False): 60, (False, True): 60}


def test_long_junk_is_repetitive():
    at = LABELLERS.index("repetition")
    rare = [f"w{i * i % 9973}" for i in range(700)]
    for junk in (["word"] * 5_000, rare[:25] * 200, rare * 8, ["word"] * 1_500):
        assert votes(" ".join(junk))[at] == "-"
    draw = np.random.default_rng(3)
    assert votes(" ".join(f"w{int(w)}" for w in draw.zipf(1.3, 20_000)))[at] != "-" and votes(" ".join(rare[:60]))[at] == "+"


def filled(sizes, budget=Fraction(3, 2), cap=2):
    """Targets by sorting sources by the level at which each is full, instead of rounds over sums."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, live, out = budget * sum(sizes.values()), dict(weight), {}
    for s in sorted(sizes, key=lambda s: Fraction(sizes[s], weight[s])):
        out[s] = min(cap * sizes[s], weight[s] * left / sum(live.values()))
        left -= out[s]
        del live[s]
    return out


def test_mix_equals_plain_targets(spark):
    draw = np.random.default_rng(2)
    for n in (1, 2, 5, 17):
        sizes = {f"s{i}": int(draw.zipf(1.3) % 5_000) for i in range(n)}
        docs = spark.createDataFrame([(i, "w " * z, s) for i, (s, z) in enumerate(sizes.items())], "doc_id long, text string, source string")
        want = filled(sizes)
        assert {f"s{r['doc_id']}": pytest.approx(r["target"]) for r in mix(docs).collect()} == {s: float(t) for s, t in want.items()}


def test_mix_keeps_keys_and_bounds_groups(spark):
    rows = [(9007199254740993 + 2 * i, "a b c " * (i % 7), f"s{i % 3}") for i in range(300)] + [(None, "one two", "x")] * 5_000 + [(5, "q w e", None)] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (sorted(map(str, mix(d, bucket_rows=50, fan_in=4).collect())) for d in (docs, docs.repartition(7)))
    assert once == again
    got = mix(docs, bucket_rows=50, fan_in=4).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(k for k, _, _ in rows)
    for source in ("s0", "s1", "s2", "x", None):
        own = [r for r, s in zip(sorted(got, key=lambda r: str(r["doc_id"])), (s for _, _, s in sorted(rows, key=lambda r: str(r[0]))), strict=True) if s == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    text = mix(docs.selectExpr("concat('k', doc_id) as doc_id", "text", "source"))
    assert text.schema["doc_id"].dataType.simpleString() == "string" and text.filter("doc_id = 'k9007199254740995'").count() == 1


def test_mix(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mix(docs).collect()
    again = {r["doc_id"]: r["taken"] for r in mix(docs.repartition(5)).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows} == again and all(r["taken"] <= 2 * r["size"] for r in rows)
    by = collections.defaultdict(list)
    for r, d in zip(sorted(rows, key=lambda r: r["doc_id"]), docs.select("doc_id", "source").orderBy("doc_id").collect(), strict=True):
        by[d["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) and own[0]["target"] <= 2 * own[0]["source_size"] + 1e-6


def components(docs):
    sets = {}
    for r in docs:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for k in sorted(sets):
        for o, n in collections.Counter(o for s in sets[k] for o in holders[s]).items():
            if 100 * n >= 85 * (len(sets[k]) + len(sets[o]) - n):
                a, b = sorted((find(k), find(o)))
                root[b] = a
        for s in sets[k]:
            holders[s].append(k)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("cells", [{}, {"cell_shingles": 4_000}, {"cell_sets": 3}, {"cell_sets": 1, "cell_shingles": 50}])
def test_jaccard_equals_brute_force(spark, cells):
    base = [f"w{i}" for i in range(60)]
    near = [(1000 + k, " ".join(base[: 7 * k % 50] + ["x"] * (k % 3) + base[7 * k % 50 :]), None, None, 0) for k in range(40)]
    sized = [(2000 + n, " ".join(base[:n]), None, None, 0) for n in range(1, 60)]
    docs = table(spark, SF, "documents").union(spark.createDataFrame(near + sized + [(3000, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(docs, **cells).collect()}
    assert got == components(docs.select("doc_id", "text").collect())


def test_representatives(spark):
    docs = awkward(spark)
    kept = J.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, 9]))


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        docs = after
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() and out.filter("taken > 2 * size").count() == 0


#: Clauses in which the grammar, not the words, tells what is toxic: the same insults and verbs are in both lists.
_TOXIC = ("you {i} leave us", "they are {i} all of them", "what a {i} this is", "I will {t} you tonight", "we shall {t} them all", "the {i} came back")
_CLEAN = ("nobody is not a {i} here", "he said that this is a {i} word", "the report quoted {i} as a slur", "never a {i} again", "we {t} the logs every night", "please {t} the old process", "it was not {i} at all", "she wrote {i} in her essay")


#: All words of both but the insults and the verbs, so that no other word tells them apart.
_FILLER = re.sub(r"\{.\}", "", " ".join(_TOXIC + _CLEAN))


def grammar_rows(seed, n):
    draw = np.random.default_rng(seed)
    out = []
    for k in range(n):
        toxic = int(draw.integers(2))
        say = str(draw.choice(_TOXIC if toxic else _CLEAN)).format(i=draw.choice(["zorg", "blik", "vrunt"]), t=draw.choice(["kill", "burn", "destroy"]))
        out.append((k, f"{_FILLER}. {say}. The day was long.", toxic))
    return out


def test_grammar_does_better_than_its_lexicon(spark):
    rows = grammar_rows(1, 1_500)
    # Learned from documents in which insults are mostly used as insults, so that they are in the lexicon.
    rows += [(9_000 + k, f"you {w}", 1) for k, w in enumerate(["zorg", "blik", "vrunt"] * 200)]
    rows += [(10_000 + k, f"{_FILLER}. The day was long.", 0) for k in range(12_000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = TX.train(docs, labels, "doc_id", "text", "toxic", 20_000)
    assert {"zorg$", "blik$", "vrunt$"} <= set(model.lexicon.entries)
    assert model.weights.negation < 0.5 > model.weights.report
    held = [(t, y) for k, t, y in rows if k < 9_000 and zlib.crc32(str(k).encode()) % 5 == 0]
    plain = TX.Tagger(model.lexicon, TX.Grammar.of(TX.Weights(1, 0, 1, 1)))
    whole = TX.Tagger(model.lexicon, TX.Grammar.of(model.weights))

    def best(tagger):
        """The share of right verdicts at the best threshold on the mass."""
        mass = [tagger.mass(t) for t, _ in held]
        return max(sum((m > cut) == bool(y) for m, (_, y) in zip(mass, held, strict=True)) for cut in {*mass, -1.0}) / len(held)

    assert best(whole) > 0.97 > 0.8 > best(plain)
    got = {r["doc_id"]: r["predicted"] for r in TX.toxicity(docs, labels).filter("held_out").collect()}
    mine = [(got[k], y) for k, _, y in rows if k < 9_000 and k in got]
    assert sum(p == y for p, y in mine) > 0.95 * len(mine)


def test_composed_machines_equal_their_parts():
    alphabet = ("I", "T", "Y", "N", "R", ".")
    one = TX.near(alphabet, "Y", {"I": "A"}, 2, lambda t: 3.0)
    two = TX.after(one.written(), "R", {"A": "Q"}, 0.5)
    both = TX.compose(one, two)
    draw = np.random.default_rng(2)
    for _ in range(300):
        tags = draw.choice(alphabet, 12).tolist()
        middle, w = one.run(tags)
        out, x = two.run(middle)
        assert both.run(tags) == (out, [a * b for a, b in zip(w, x, strict=True)])


def test_arc_weights_multiply_along_a_match():
    weights = TX.Weights(2.0, 3.0, 0.5, 0.25)
    found = lambda tags: [(i, k, w) for i, k, w in TX.Grammar.of(weights).matches(list(tags))]
    assert found("T") == [] and found("T..Y") == [(0, "H", 3.0)] and found("T....Y") == [] and found("NI") == [(1, "I-", 0.5)]
    assert found("IR") == [(0, 'I"', 0.25)] and found("RI") == [(1, 'I"', 0.25)] and found("YI") == found("YI") == [(1, "A", 2.0)] and found("RNYI") == [(3, 'A-"', 0.25)]
    tagger = TX.Tagger(TX.Lexicon.of({"zorg$": 5.0}), TX.Grammar.of(weights))
    assert tagger.mass("You zorg! He said: no zorg.") == pytest.approx(5 * 2 + 5 * 2 * 0.5 * 0.25)
    parts = np.array(tagger.by_class("You zorg! He said: no zorg."))
    assert parts @ np.exp(TX._USES @ np.log([2.0, 3.0, 0.5, 0.25])) == pytest.approx(tagger.mass("You zorg! He said: no zorg."))


def test_repeated_labelled_rows_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, "you zorg")] * 500 + [(1, f"text {i}") for i in range(50)] + [(i, "fine") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 40)], "doc_id long, toxic int")
    sample = TX.learning_documents(docs, labels, "doc_id", "text", "toxic", 20).collect()
    again = TX.learning_documents(docs.repartition(5), labels, "doc_id", "text", "toxic", 20).collect()
    assert len(sample) == 20 and sorted(sample) == sorted(again)


def kinds_of_hosts(seed):
    """Two kinds of hosts under the same suffixes, told apart by how their urls look; rules know half of the hosts."""
    draw = np.random.default_rng(seed)
    rows, rules, truth = [], [], {}
    for h in range(80):
        bad = h % 2 == 1
        name = "".join(draw.choice(list("abcdefgh"), 6)) + ("-" + str(draw.integers(10_000, 99_999)) if bad else "") + (".shop.com", ".site.org")[h // 2 % 2]
        truth[name] = "block" if bad else "allow"
        if h % 4 < 2:
            rules.append(UrlRule(name, "/", truth[name]))
        for k in range(15):
            tail = f"p{draw.integers(10**6)}?a={draw.integers(10**5)}&b={draw.integers(10**5)}&c=1" if bad else "/".join(["news", "story"][: 1 + k % 2])
            rows.append((len(rows), f"https://{name}/{tail}"))
    return rows, tuple(rules), truth


def test_trees_judge_hosts_that_no_rule_knows(spark):
    rows, rules, truth = kinds_of_hosts(4)
    pages = spark.createDataFrame(rows, "page_id long, url string")

    def right(only=None):
        got = url_filter(pages, rules=rules, only=only).filter("rule is null").collect()
        return sum(r["verdict"] == truth[r["host"]] for r in got) / len(got)

    suffixes = tuple(f"{what}{k}" for k in (1, 2, 3) for what in ("share", "common"))
    assert right() > 0.95 > 0.7 > right(only=suffixes)


def test_suffix_shares_leave_out_the_own_fold(spark):
    """A brute-force count of what a row's suffix share is made of."""
    from pyspark.sql import functions as F

    rows = [(i, f"h{i % 7}.a.com", i % 3 == 0, i % 2) for i in range(60)]
    df = spark.createDataFrame([(i, h, float(y) if known else None, int(h[1]) % 5) for i, h, known, y in rows], "id long, host string, label double, fold int")
    got = {r["host"]: r for r in U.host_statistics(df, 60, 0.25).collect()}
    for h in {h for _, h, _, _ in rows}:
        for name, all_of in (("share", True), ("known_share", False)):
            seen = [y for _, o, k, y in rows if k and (all_of or int(o[1]) % 5 != int(h[1]) % 5)]
            want = 0.25
            for _ in range(2):  # the last label, then the last two: both are those of all hosts
                want = (sum(seen) + want * 20) / (len(seen) + 20)
            assert got[h][f"{name}2"] == pytest.approx(want)
        own = [y for _, o, k, y in rows if k and o == h]
        assert got[h]["share3"] == pytest.approx((sum(own) + got[h]["share2"] * 20) / (len(own) + 20)) and got[h]["known_share3"] == pytest.approx(got[h]["known_share2"])
        assert got[h]["common3"] == pytest.approx(math.log1p(sum(o == h for _, o, _, _ in rows) / 60))



def contaminated_by_hand(text, items):
    """The contract's rule on word lists: 13-word windows of items, shorter items whole; 5 % of words hit."""
    split = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    words, hit = split(text), set()
    for item in items:
        own = split(item)
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline_equals_brute_force(spark, duck):
    import corpus_pipeline

    from lociform.llm import language_id as LI

    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    frame = lambda ids: spark.createDataFrame([rows[k] for k in ids], table(spark, SF, "documents").schema)
    ids = lambda name, kept: sorted(r["doc_id"] for r in stages[name](spark, frame(kept), SF).collect())

    kept = sorted(r[0] for r in duck.execute(f"select doc_id from ({llm.oracle_sql()['op1_quality_rules']}) where kept").fetchall())
    assert ids("quality_rules", list(rows)) == kept
    model = LI.train(frame(kept).filter(LI.learning_rows("doc_id")))
    told = [k for k in kept if (lambda p: p[0] != "und" and p[1] >= 0.5)(model.predict(rows[k]["text"]))]
    assert ids("language_id", kept) == told and len(told) > 0.9 * len(kept)
    first = sorted(k for k, (_, c) in components([rows[k] for k in told]).items() if k == c)
    assert ids("jaccard_join", told) == first and len(first) < len(told)
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    clean = [k for k in first if not contaminated_by_hand(rows[k]["text"], items)]
    assert ids("decontamination", first) == clean
    sizes = collections.Counter()
    for k in clean:
        sizes[rows[k]["source"]] += len((rows[k]["text"] or "").encode().split())
    goal = filled(sizes)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == clean
    for source, size in sizes.items():
        own = [got[k] for k in clean if rows[k]["source"] == source]
        assert all(r["source_size"] == size and r["target"] == pytest.approx(float(goal[source])) and r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_contaminated_documents_are_found(spark):
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    for r in decontaminate(table(spark, SF, "documents"), table(spark, SF, "benchmark")).join(table(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect():
        assert r["contaminated"] == contaminated_by_hand(r["text"], items)


def test_hubs_and_common_keys_are_broadcast(spark):
    """Components of a graph with hubs and long chains, against a plain union of sets."""
    from lociform.llm.components import connected

    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 400, (200, 2))] + [(1000, i) for i in range(1001, 2001)] + [(i, i + 1) for i in range(3000, 3030)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_long_words_do_not_travel_with_the_tasks(spark, monkeypatch):
    """Words and pre-tokens of 100 kB, and frequent ones at that: they are joined, and results stay."""
    from pyspark import SparkContext

    long = ["".join(chr(97 + (i * k) % 26) for k in range(100_000)) for i in range(1, 12)]
    rows = [(i, " ".join([long[i % 11], long[0], "and some short words", long[0]])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sizes.append(sum(len(x) for part in value if isinstance(part, (list, dict)) for x in part if isinstance(x, (str, bytes)))), send(self, value))[1])
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got == {i: len(coder.encode(t)) for i, t in rows}
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    here, there = ({r["doc_id"]: tuple(r)[1:] for r in L.lm_score(docs, common_bytes=b).select(columns).collect()} for b in (64, 1_000_000))
    assert all(here[k] == pytest.approx(there[k]) and here[k][1] > 0 for k in here)
    assert sizes[0] < 1_000 and len(sizes) == 3 and sizes[1] < 1_000 < sizes[2]
