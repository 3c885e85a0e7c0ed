"""Metrics as Column expressions and small aggregations: tokens, preferences, classification, text overlap, run statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.schema import IGNORE

# Tokens.


def token_accuracy(predicted: Column, labels: Column) -> Column:
    """Part of a row's labels met by the prediction one place before; null where a row has none."""
    hits = F.zip_with(F.slice(predicted, 1, F.greatest(F.size(predicted) - 1, F.lit(0))), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda p, y: F.when(y != IGNORE, (p == y).cast("double")))
    seen = F.filter(hits, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x), F.size(seen))


def argmax(x: Column) -> Column:
    """Place of the first maximum."""
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def masked_sum(values: Column, labels: Column) -> Column:
    """Sum of values[i] over labels[i + 1] that count: values are log-probabilities of the next label."""
    pairs = F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda v, y: F.when(y != IGNORE, v).otherwise(F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def counted(labels: Column) -> Column:
    return F.size(F.filter(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda y: y != IGNORE))


def split_sum(values: Column, labels: Column, shared: Column, alpha: float) -> Column:
    """masked_sum with what lies beyond the shared length weighted by alpha. shared: the pair's shorter answer."""
    y = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    start = F.array_position(F.transform(y, lambda v: v != IGNORE), True) - 1
    kept = F.transform(y, lambda v, i: F.when(v == IGNORE, 0.0).when(i < start + shared, 1.0).otherwise(F.lit(alpha)))
    return F.aggregate(F.zip_with(F.slice(values, 1, F.size(y)), kept, lambda v, k: v * k), F.lit(0.0), lambda a, x: a + x)


def perplexity(nll: Column, labels: Column) -> Column:
    """exp of a row's mean loss over its labels."""
    return F.exp(F.try_divide(masked_sum(nll, labels), counted(labels)))


def corpus_perplexity(loss: Column) -> Column:
    return F.when(loss > 709.78, F.lit(math.inf)).otherwise(F.exp(loss))


def log_sigmoid(x: Column) -> Column:
    """Stable for either sign."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_sum_exp(x: Column) -> Column:
    return F.array_max(x) + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - F.array_max(x))), F.lit(0.0), lambda a, b: a + b))


def nll(logits: Column, label: Column) -> Column:
    """Cross-entropy of a token from its logits."""
    return log_sum_exp(logits) - F.get(logits, label)


def regularised(loss: Column, cross_entropy: Column, weight: float) -> Column:
    """A loss with a share of the tokens' cross-entropy; none at a weight of 0 or where there is no label."""
    return loss + weight * F.coalesce(cross_entropy, F.lit(0.0)) if weight > 0 else loss


def dft_weight(loss: Column) -> Column:
    """A token's loss weighted by its own probability."""
    return loss * F.exp(-loss)


def kl(policy: Column, reference: Column) -> Column:
    """Divergence of softmax(reference) from softmax(policy) at one token."""
    q = softmax(reference)
    log_p, log_q = log_sum_exp(policy), log_sum_exp(reference)
    terms = F.zip_with(F.arrays_zip(q.alias("q"), reference.alias("r")), policy, lambda z, p: z["q"] * ((z["r"] - log_q) - (p - log_p)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def top_entropy(logits: Column, k: int = 20) -> Column:
    """Entropy of the k largest logits' softmax, divided by 3."""
    top = F.slice(F.sort_array(logits, asc=False), 1, k)
    z = log_sum_exp(top)
    return F.aggregate(F.transform(top, lambda v: -F.exp(v - z) * (v - z)), F.lit(0.0), lambda a, x: a + x) / 3.0


def eaft_weight(loss: Column, logits: Column, alpha: float = 1.0) -> Column:
    return loss * F.pow(top_entropy(logits), alpha)


def answer_place(labels: Column) -> Column:
    """Place of the first label that counts, 0 where none does."""
    return F.greatest(F.array_position(F.transform(labels, lambda y: y != IGNORE), True).cast("int") - 1, F.lit(0))


def answer_class(labels: Column, negative: int, positive: int) -> Column:
    """0 or 1 by the answer's token; null for another token."""
    token = F.get(labels, answer_place(labels))
    return F.when(token == negative, 0).when(token == positive, 1)


def last_score(values: Column, mask: Column) -> Column:
    """The value at the last seen position."""
    return F.get(values, F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int")) - 1)


def trim_query(ids: Column, pad: int) -> Column:
    """Ids without the padding in front."""
    start = F.array_position(F.transform(ids, lambda x: x != pad), True).cast("int")
    return F.when(start == 0, F.slice(ids, 1, 0)).otherwise(F.slice(ids, start, F.size(ids)))


def trim_response(ids: Column, pad: int, eos: int) -> Column:
    """Ids up to the last that isn't padding; with equal end and padding one more is kept; an all-padding row keeps one."""
    last = F.size(ids) - F.array_position(F.transform(F.reverse(ids), lambda x: x != pad), True).cast("int") + 1
    some = F.exists(ids, lambda x: x != pad)
    return F.slice(ids, 1, F.when(~some, 1).otherwise(last + (1 if pad == eos else 0)))


def finished(ids: Column, eos: int) -> Column:
    """struct(length, reason): tokens up to the first end, that included."""
    at = F.array_position(ids, eos).cast("int")
    return F.struct(F.when(at > 0, at).otherwise(F.size(ids)).alias("length"), F.when(at > 0, "stop").otherwise("length").alias("reason"))


# Preferences: columns of summed log-probabilities.


def odds_ratio_loss(chosen: Column, rejected: Column, beta: float) -> Column:
    odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
    return -chosen + beta * -log_sigmoid(odds)


def simple_loss(chosen: Column, rejected: Column, beta: float, gamma: float) -> Column:
    return -log_sigmoid(beta * (chosen - rejected - gamma / beta))


def sigmoid_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float, smoothing: float = 0.0) -> Column:
    x = beta * ((chosen - rejected) - (ref_chosen - ref_rejected))
    return -log_sigmoid(x) * (1 - smoothing) - log_sigmoid(-x) * smoothing


def reward_loss(chosen: Column, rejected: Column) -> Column:
    return -log_sigmoid(chosen - rejected)


def combined(loss: Column, other: Column, weight: float) -> Column:
    return (loss + weight * other) / (1 + weight)


def running_sums(df: DataFrame, order: str, values: list[str], chunk: int = 4096) -> DataFrame:
    """df with the running sum of each value by an integer order column: sums per chunk first, so no task orders all rows."""
    part = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    sums = part.groupBy("_chunk").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_chunk", *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    own = Window.partitionBy("_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return part.join(bases, "_chunk").select(*df.columns, *[(F.sum(v).over(own) + F.col(f"_{v}")).alias(f"running_{v}") for v in values])


def bco_loss(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """df with baseline (mean of all rewards up to the row's batch) and loss. Rows have batch_id."""
    batches = df.groupBy("batch_id").agg(F.sum(F.col(chosen) + F.col(rejected)).alias("s"), (F.count("*") * 2).alias("c"))
    base = running_sums(batches, "batch_id", ["s", "c"]).select("batch_id", (F.col("running_s") / F.col("running_c")).alias("baseline"))
    return df.join(base, "batch_id").withColumn("loss", -log_sigmoid(F.col(chosen) - F.col("baseline")) - log_sigmoid(-(F.col(rejected) - F.col("baseline"))))


def preference_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Means of rewards, accuracy and margin of chosen/rejected rewards."""
    return df.groupBy(*keys).agg(
        F.avg("chosen").alias("rewards_chosen"), F.avg("rejected").alias("rewards_rejected"), F.avg((F.col("chosen") > F.col("rejected")).cast("double")).alias("rewards_accuracy"), F.avg(F.col("chosen") - F.col("rejected")).alias("rewards_margin"),
    )


def mean_of_means(df: DataFrame, value: str, batch: str, rank: str) -> DataFrame:
    """Mean over ranks of each rank's mean of batch means."""
    inner = df.groupBy(rank, batch).agg(F.avg(value).alias("m")).groupBy(rank).agg(F.avg("m").alias("m"))
    return inner.agg(F.avg("m").alias(value))


def feedback_summary(df: DataFrame, tag: str = "tag") -> DataFrame:
    """Per class sums over counts of reward and log-probability, and the margin."""
    ratio = lambda x, on: F.try_divide(F.sum(F.when(on, F.nanvl(F.col(x), F.lit(0.0)))), F.count_if(on))
    yes, no = F.col(tag), ~F.col(tag)
    out = [ratio(x, on).alias(f"{x}_{side}") for x in ("reward", "logp") for side, on in (("chosen", yes), ("rejected", no))]
    return df.agg(*out).withColumn("margin", F.col("reward_chosen") - F.col("reward_rejected"))


# Classification.


def normal_label(text: Column, negative: str, positive: str) -> Column:
    """1 or 0 for the two class texts, an integer else."""
    return F.when(text == positive, 1).when(text == negative, 0).otherwise(text.cast("int"))


def binary_softmax(negative: Column, positive: Column) -> Column:
    top = F.greatest(negative, positive)
    return F.exp(positive - top) / (F.exp(negative - top) + F.exp(positive - top))


THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def confusion(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, p: str = "p", y: str = "y") -> DataFrame:
    """(threshold, tp, fp, fn, tn): one pass, an accumulator per threshold."""
    hit = lambda t: F.col(p) >= t
    cells = {"tp": lambda t: hit(t) & (F.col(y) == 1), "fp": lambda t: hit(t) & (F.col(y) == 0), "fn": lambda t: ~hit(t) & (F.col(y) == 1), "tn": lambda t: ~hit(t) & (F.col(y) == 0)}
    row = df.agg(*[F.count_if(c(t)).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, c in cells.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in cells]) for i, t in enumerate(thresholds)])).alias("x")).select("x.*")


def ratios(df: DataFrame) -> DataFrame:
    """df with accuracy, precision, recall and f1 of tp, fp, fn, tn; a zero denominator gives 0."""
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = df.withColumn("accuracy", part(tp + tn, tp + fp + fn + tn)).withColumn("precision", part(tp, tp + fp)).withColumn("recall", part(tp, tp + fn))
    return df.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_steps(df: DataFrame, p: str = "p", y: str = "y", ranges: int | None = None) -> DataFrame:
    """(p, pos, neg, tp, fp): rows per distinct score and running sums from the highest; ranges of scores are summed apart, so no task sorts all.

    Ranges are quantiles of the distinct scores, wherever they lie: as many as the session's shuffle partitions by default.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = df.groupBy(F.col(p).alias("p")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    borders = steps.agg(F.percentile_approx("p", [i / ranges for i in range(1, ranges)], 50 * ranges)).first()[0] if ranges > 1 else []
    found = F.array(*[F.lit(float(b)) for b in sorted(set(borders or []))]).cast("array<double>")
    steps = steps.withColumn("_r", F.size(F.filter(found, lambda b: b < F.col("p"))))
    sums = steps.groupBy("_r").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    above = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_r", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_q").over(above), F.lit(0)).alias("_q"))
    own = Window.partitionBy("_r").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(base, "_r").select("p", "pos", "neg", (F.sum("pos").over(own) + F.col("_p")).alias("tp"), (F.sum("neg").over(own) + F.col("_q")).alias("fp"))


def roc_auc(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """auc (null unless both classes occur): pairs won plus half of those tied."""
    steps = score_steps(df, p, y)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("pos") * F.col("neg") * 0.5)
    return steps.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def best_f1(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(threshold, f1): every score is a candidate, the lowest of the best wins; 0.5 and -1 for no rows."""
    steps = score_steps(df, p, y)
    total = df.agg(F.count_if(F.col(y) == 1).alias("total"))
    scored = steps.crossJoin(F.broadcast(total)).select("p", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("total")), F.lit(0.0)).alias("f1"))
    best = scored.agg(F.min_by(F.struct("p", "f1"), F.struct((-F.col("f1")).alias("a"), F.col("p").alias("b"))).alias("x"))
    return best.select(F.coalesce(F.col("x.p"), F.lit(0.5)).alias("threshold"), F.coalesce(F.col("x.f1"), F.lit(-1.0)).alias("f1"))


def class_head(logit0: Column, logit1: Column, names: tuple[str, str]) -> Column:
    """struct(p0, p1, class, label): the second class from a probability of one half on."""
    p1 = binary_softmax(logit0, logit1)
    return F.struct((1 - p1).alias("p0"), p1.alias("p1"), (p1 >= 0.5).cast("int").alias("class"), F.when(p1 >= 0.5, names[1]).otherwise(names[0]).alias("label"))


def strict_class(logit0: Column, logit1: Column) -> Column:
    """The second class only above the first."""
    return (logit1 > logit0).cast("int")


def focal_loss(p: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Binary focal loss of the second class's probability."""
    pt = F.when(y == 1, p).otherwise(1 - p)
    at = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return -at * F.pow(F.greatest(1 - pt, F.lit(1e-6)), gamma) * F.log(F.greatest(pt, F.lit(1e-12)))


def invalid(logits: Column, classes: tuple[str, str]) -> Column:
    """Whether a logits map lacks a class or holds a value that is no number."""
    bad = F.coalesce(F.size(logits) <= 0, F.lit(True))
    for c in classes:
        value = F.try_element_at(logits, F.lit(c))
        bad = bad | value.isNull() | F.isnan(value)
    return bad


def mistakes(df: DataFrame, threshold: float, n: int, seed: int) -> DataFrame:
    """n false negatives and n false positives, in a seeded order."""
    kind = F.when((F.col("y") == 1) & (F.col("p") < threshold), "fn").when((F.col("y") == 0) & (F.col("p") >= threshold), "fp")
    rows = df.withColumn("kind", kind).where("kind is not null")
    take = lambda k: rows.where(F.col("kind") == k).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)
    return take("fn").unionByName(take("fp"))


# Multiple choice.

CHOICES = ("A", "B", "C", "D")


def choice_prompt(question: Column, options: dict[str, Column], lang: str = "en") -> Column:
    """The question, its options that aren't null, and the answer mark."""
    parts = [F.coalesce(F.concat(F.lit(f"\n{c}. "), o), F.lit("")) for c, o in options.items()]
    return F.concat(question, *parts, F.lit({"en": "\nAnswer:", "zh": "\n答案："}[lang]))


def choice_system(subject: Column, lang: str = "en") -> Column:
    a, b = {"en": ("The following are multiple choice questions (with answers) about ", ".\n\n"), "zh": ("以下是中国关于", "考试的单项选择题，请选出其中的正确答案。\n\n")}[lang]
    return F.concat(F.lit(a), subject, F.lit(b))


def predicted_choice(logits: Column) -> Column:
    """Letter of the largest of four logits."""
    return F.get(F.array(*map(F.lit, CHOICES)), argmax(logits))


def accuracy_by_category(df: DataFrame) -> DataFrame:
    """(category, accuracy, n) with all rows again under Average."""
    both = df.select(F.explode(F.array("category", F.lit("Average"))).alias("category"), "correct")
    return both.groupBy("category").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def accuracy_lines(df: DataFrame) -> DataFrame:
    """A report line per category that has rows."""
    return accuracy_by_category(df).select(F.format_string("%15s: %.2f", "category", F.col("accuracy") * 100).alias("line"))


# Text overlap.


def segment(text: str) -> list[str]:
    """White space splits words; each CJK character is a word."""
    out = []
    for w in text.split():
        run = ""
        for c in w:
            if "㐀" <= c <= "鿿":
                out += [run, c] if run else [c]
                run = ""
            else:
                run += c
        if run:
            out.append(run)
    return out


def _grams(words, n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _f1(hits: float, a: int, b: int) -> float:
    p, r = hits / a if a else 0.0, hits / b if b else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def rouge(predicted: str, reference: str, split: Callable[[str], list[str]] = segment) -> tuple[float, float, float]:
    """F1 of words, word pairs (distinct n-grams) and the longest common subsequence, times 100."""
    a, b = split(predicted), split(reference)
    if not a or not b:
        return 0.0, 0.0, 0.0
    out = []
    for n in (1, 2):
        x, y = set(_grams(a, n)), set(_grams(b, n))
        out.append(_f1(len(x & y), len(x), len(y)))
    row = [0] * (len(b) + 1)
    for w in a:
        corner = 0
        for j, v in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if w == v else max(row[j], row[j - 1])
    out.append(_f1(row[-1], len(a), len(b)))
    return tuple(round(100 * x, 4) for x in out)


def bleu4(predicted: str, reference: str) -> float:
    """Sentence BLEU of characters with geometric smoothing of empty orders, times 100."""
    a, b = list(predicted), list(reference)
    if not a:
        return 0.0
    logs, k = 0.0, 1
    for n in range(1, 5):
        x, y = _grams(a, n), _grams(b, n)
        hits, total = sum((x & y).values()), max(1, sum(x.values()))
        if n == 1 and not hits:
            return 0.0
        if hits:
            value = hits / total
        else:
            value = 1 / (2**k * total)
            k += 1
        logs += math.log(value) / 4
    short = 1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a))
    return round(100 * short * math.exp(logs), 4)


def text_overlap(predicted: Column | str, reference: Column | str) -> Column:
    """struct of ROUGE-1, ROUGE-2, ROUGE-L and BLEU-4."""

    @F.pandas_udf("rouge_1 double, rouge_2 double, rouge_l double, bleu_4 double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, r in batches:
            rows = [(*rouge(a or "", b or ""), bleu4(a or "", b or "")) for a, b in zip(p, r)]
            yield pd.DataFrame(rows, columns=["rouge_1", "rouge_2", "rouge_l", "bleu_4"])

    return run(predicted, reference)


# Runs.


def length_cdf(df: DataFrame, length: str, interval: int) -> DataFrame:
    """(bin, n, cumulative, percent) by bins of length; the window runs over bins only."""
    bins = df.groupBy((F.floor(F.col(length) / interval) * interval).alias("bin")).agg(F.count("*").alias("n"))
    by = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.select("bin", "n", F.sum("n").over(by).alias("cumulative"), (F.sum("n").over(by) * 100.0 / F.sum("n").over(Window.partitionBy())).alias("percent"))


def learning_rate(df: DataFrame, cutoff: int, batch: int, small: bool = False) -> DataFrame:
    """(valid_ratio, tokens, lr) of padded batches."""
    valid = F.sum(F.size(F.filter("labels", lambda y: y != IGNORE)))
    ratio = valid / F.sum(F.size("labels"))
    lr = 3e-4 * F.sqrt(F.lit(float(cutoff * batch)) * F.col("valid_ratio") / 4_000_000) / (6.0 if small else 1.0)
    return df.agg(ratio.alias("valid_ratio")).select("valid_ratio", (F.lit(float(cutoff * batch)) * F.col("valid_ratio")).alias("tokens"), lr.alias("lr"))


def tokens_per_second(df: DataFrame, length: str, epochs: float, seconds: float, world: int) -> DataFrame:
    return df.agg((F.sum(length) * epochs / seconds / world).alias("tokens_per_second"))


#: Peak operations a second of devices; fixed values.
DEVICE_PEAK = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "V100": 125e12, "4090": 98e12}


def model_flops(batch: Column, length: Column, hidden: Column, vocab: Column, inner: Column, heads: Column, kv_heads: Column, layers: Column, tied: Column, backward: bool = True, recompute: bool = False, flash: bool = False) -> Column:
    """Operations of one pass of a decoder: per token and layer three MLP and four attention matrices (two products an element), attention itself, and embeddings."""
    d = lambda c: c.cast("double")
    batch, length, hidden, vocab, inner, layers = map(d, (batch, length, hidden, vocab, inner, layers))
    mlp = 6 * hidden * inner
    kv = F.floor(2 * hidden * hidden * d(kv_heads) / d(heads))
    attention = 4 * hidden * hidden + 2 * kv
    scores = batch * layers * 4 * hidden * length * length
    body = batch * length * layers * (mlp + attention) + scores
    ends = batch * length * hidden * vocab * F.when(tied, 1).otherwise(2)
    return (1 + 2 * backward + recompute) * body + (1 + 2 * backward) * ends + (scores if flash else F.lit(0.0))


def ema(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """(keys, order, smoothed): exponential smoothing of each series; its weight follows the series' length.

    A series streams through its task in order with one number carried on, so time is linear and memory that of a batch.
    """
    sized = df.select(*keys, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    rows = sized.repartition(*keys).sortWithinPartitions(*keys, "_o")
    n_keys = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0.0
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c] for c in pdf.columns)):
                key, (_, v, n) = row[:n_keys], row[n_keys:]
                weight = 1.8 * (1 / (1 + math.exp(-0.05 * n)) - 0.5)
                last = (v if key != now else last) * weight + (1 - weight) * v
                now = key
                out.append(last)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, order: pdf["_o"], "smoothed": out})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return rows.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, order)) + ", smoothed double")


def weighted_mean(value: Column, n: Column) -> Column:
    return F.try_divide(F.sum(value * n), F.sum(n))


def latest_progress(df: DataFrame) -> DataFrame:
    """The last log line with percentage and remaining seconds."""
    last = df.agg(F.max_by(F.struct("current_steps", "total_steps", "elapsed"), "current_steps").alias("x")).select("x.*")
    left = F.try_divide(F.col("elapsed"), F.col("current_steps")) * (F.col("total_steps") - F.col("current_steps"))
    return last.select("*", F.round(F.col("current_steps") / F.col("total_steps") * 100, 2).alias("percentage"), left.alias("remaining"))


def loss_series(df: DataFrame, metric: str, keep_zero: bool = True) -> DataFrame:
    """(step, metric) of log lines that have it; one form also leaves zeros out."""
    good = F.col(metric).isNotNull() if keep_zero else F.coalesce(F.col(metric) != 0, F.lit(False))
    return df.where(good).select("step", metric)


def duration(seconds: Column) -> Column:
    """h:mm:ss, with days in front where there are any."""
    s = F.floor(seconds).cast("bigint")
    days = F.floor(s / 86400)
    clock = F.format_string("%d:%02d:%02d", F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
    return F.when(days > 0, F.concat(days.cast("string"), F.when(days == 1, " day, ").otherwise(" days, "), clock)).otherwise(clock)
