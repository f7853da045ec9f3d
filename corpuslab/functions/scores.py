"""Scores of texts, pairs of texts, losses and attention rows, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.text import collapse, let, words

SENTENCE_END = "।"


def doc_hash(text: Column) -> Column:
    return F.sha2(text, 256)


# ---------------------------------------------------------------- n-grams and shingles


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbours of an array; none where it is shorter."""

    def runs(x: Column) -> Column:
        return F.when(F.size(x) < n, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.slice(x, i, n)))

    return let(tokens, runs)


def char_runs(text: Column, k: int) -> Column:
    """Runs of k characters; a shorter text is its own only one. Characters are taken apart once, so that a run costs k steps wherever it stands."""

    def runs(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, k), ""))

    return let(F.split(text, ""), runs)


def shingles(text: Column, k: int = 8) -> Column:
    """Runs of k characters after white space is collapsed; a shorter text is its own only one."""
    return char_runs(collapse(text), k)


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of positions at which two signatures agree; 0 if they are empty or of different lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(same / F.size(a))


# ---------------------------------------------------------------- answers


def exact_match(pred: Column, gold: Column) -> Column:
    """Equal, or one inside the other, after white space is collapsed; an empty one matches an empty one alone."""
    p, g = collapse(pred), collapse(gold)
    return F.when((p == "") | (g == ""), p == g).otherwise(F.contains(p, g) | F.contains(g, p))


def first_sentence(text: Column) -> Column:
    at = F.locate(SENTENCE_END, text)
    return F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise(text)


def strict_match(pred: Column, gold: Column) -> Column:
    """The prediction's first sentence is the gold answer."""
    return collapse(first_sentence(pred)) == collapse(gold)


def char_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance by the longer one's length; 1 for two empty texts."""
    p, g = collapse(a), collapse(b)
    longest = F.greatest(F.char_length(p), F.char_length(g))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.levenshtein(p, g) / longest))


def _numbered(tokens: Column) -> Column:
    """Sorted tokens, each with the number of its occurrence: a multiset as a set."""

    def numbered(x: Column) -> Column:
        # a run of equal tokens counts on from the one before
        step = lambda a, t: F.struct(t.alias("t"), F.when(a["t"] == t, a["n"] + 1).otherwise(1).alias("n"), F.concat(a["out"], F.array(F.concat_ws(" ", t, F.when(a["t"] == t, a["n"] + 1).otherwise(1).cast("string")))).alias("out"))
        return F.aggregate(x, F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")), step, lambda a: a["out"])

    return let(F.sort_array(tokens), numbered)


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multisets' intersection."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def token_f1(pred: Column, gold: Column) -> Column:
    def score(z: Column) -> Column:
        common, p, g = z["common"], z["p"], z["g"]
        return F.when((p == 0) & (g == 0), F.lit(1.0)).when((p == 0) | (g == 0) | (common == 0), F.lit(0.0)).otherwise(2.0 * (common / p) * (common / g) / (common / p + common / g))

    p, g = words(pred), words(gold)
    return let(F.struct(common_tokens(p, g).alias("common"), F.size(p).alias("p"), F.size(g).alias("g")), score)


def combined_score(rationale_f1: Column, answer_f1: Column) -> Column:
    return F.lit(0.4) * rationale_f1 + F.lit(0.6) * answer_f1


def copies_names(sentence: Column, names: Column) -> Column:
    """Whether every name stands in the sentence."""
    return F.forall(names, lambda n: F.contains(sentence, n))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays: the rows of the usual table, one for each token of a."""

    def table(z: Column) -> Column:
        first, second = z["a"], z["b"]

        def row(previous: Column, token: Column) -> Column:
            # position j + 1 of the new row: one more than the diagonal where tokens agree, else the larger neighbour
            return F.aggregate(
                F.sequence(F.lit(1), F.size(second)),
                F.array(F.lit(0)),
                lambda now, j: F.concat(now, F.array(F.when(F.get(second, j - 1) == token, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.element_at(now, -1))))),
            )

        return F.when((F.size(first) == 0) | (F.size(second) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(first, F.array_repeat(F.lit(0), F.size(second) + 1), row), -1))

    return let(F.struct(a.alias("a"), b.alias("b")), table)


def rouge_l(hypothesis: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of words."""

    def score(z: Column) -> Column:
        n, h, r = z["n"], z["h"], z["r"]
        return F.when(n == 0, F.lit(0.0)).otherwise(2.0 * (n / h) * (n / r) / (n / h + n / r))

    h, r = words(hypothesis), words(reference)
    return let(F.struct(lcs_length(h, r).alias("n"), F.size(h).alias("h"), F.size(r).alias("r")), score)


# ---------------------------------------------------------------- losses and schedules


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def bits_per_byte(loss: Column, tokens: Column, utf8_bytes: Column) -> Column:
    """Null where there are no tokens or bytes."""
    return F.when((tokens > 0) & (utf8_bytes > 0), loss / math.log(2.0) * (tokens / utf8_bytes))


def warmup_cosine(step: Column, top: float, low: float, warmup: int, total: int) -> Column:
    """Linear to the top, then a half cosine to the low rate."""
    share = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, F.lit(top) * (step + 1) / F.lit(float(warmup))).otherwise(F.lit(low) + F.lit(0.5 * (top - low)) * (1.0 + F.cos(F.lit(math.pi) * share)))


def warmup_stable_decay(step: Column, top: float, low: float, warmup: int, total: int, decay: float = 0.2) -> Column:
    """Linear to the top, level, then linear to the low rate over the last share of steps."""
    start = int(total * (1 - decay))
    share = F.least(F.lit(1.0), (step - start) / F.lit(float(max(1, total - start))))
    return F.when(step < warmup, F.lit(top) * (step + 1) / F.lit(float(warmup))).when(step < start, F.lit(top)).otherwise(F.lit(top) + (low - top) * share)


def curriculum_hops(step: Column, steps: int) -> Column:
    return F.when(step < steps // 2, 1).when(step < steps, 2)


# ---------------------------------------------------------------- attention


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(a: Column) -> Column:
    shifted = let(F.array_max(a).cast("double"), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top)))
    return let(shifted, lambda e: let(_total(e), lambda z: F.transform(e, lambda x: x / z)))


def entropy(p: Column) -> Column:
    """In nats; shares below 1e-12 count as 1e-12 in the logarithm."""
    return -_total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(1e-12)))))


def mean_distance(p: Column, query: Column) -> Column:
    """Mean distance of the attended positions from the query's."""
    return _total(F.transform(p, lambda x, i: x * F.abs(query - i)))


def jensen_shannon(p: Column, q: Column) -> Column:
    def halves(z: Column) -> Column:
        m = F.zip_with(z["p"], z["q"], lambda x, y: (x + y) / 2)

        def divergence(a: Column) -> Column:
            return _total(F.zip_with(a, m, lambda x, y: x * (F.ln(F.greatest(x, F.lit(1e-12))) - F.ln(F.greatest(y, F.lit(1e-12))))))

        return F.lit(0.5) * divergence(z["p"]) + F.lit(0.5) * divergence(z["q"])

    return let(F.struct(p.alias("p"), q.alias("q")), halves)
