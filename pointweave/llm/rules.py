"""Quality rules whose cutoffs are chosen with a guarantee on false rejection.

measure() counts, for every text, what the rules look at. learn() takes labelled rows, in two parts dealt by a hash of
doc_id. The first part proposes, for each stratum and rule, the strictest cutoff of a grid that rejects a good document in at
most RISK / rules of cases and bad ones more often. The path to the proposal goes in STEPS steps, from loose to strict for
all rules together. On the second part, the holdout, the exact binomial tail tests for each step whether the rules together
can reject more than RISK of the good documents. Steps are tested in their order up to the first that fails (fixed-sequence
testing, which needs no correction over steps), each at LEVEL over the number of strata (Bonferroni), so the chance that any
stratum's rules break the bound is below LEVEL. Of the steps that passed, a stratum takes the loosest with the greatest
share of bad documents rejected less that of good ones; where none did, or without labels, its rules stay off: in each of
four strata 86 good holdout documents are the fewest that can switch them on. judge() applies the cutoffs.

Defined cases: null text counts as empty; a null stratum is its own stratum; a text without words fails the base rules;
an empty table gives no rows. Counting is one pass without shuffle; learning moves counts only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, cut, fold

RISK, LEVEL, STEPS, PROPOSE = 0.05, 0.05, 24, 4  # one in PROPOSE labelled rows proposes
BROADCAST = 10_000  # rows of a table that is sent to all tasks; a longer one is joined by shuffling
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
#: Rule: its measure (more is worse) and the loosest and strictest cutoff that are tried.
RANGE = {"symbols": (0.4, 0.01), "dup_lines": (0.9, 0.1), "repeats": (0.5, 0.05), "upper": (0.9, 0.15), "marks": (0.6, 0.02)}


def path(loose: float, strict: float, steps: int = STEPS) -> list[float]:
    """Cutoffs from loose to strict, evenly by ratio."""
    return [loose * (strict / loose) ** (i / max(1, steps - 1)) for i in range(steps)]


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def measures() -> dict[str, Column]:
    return {
        "symbols": _share("n_symbols", "word_chars"), "dup_lines": _share("n_dup_lines", "n_lines"), "repeats": _share("n_repeat_words", "n_words"),
        "upper": _share("n_upper", "n_letters"), "marks": _share("n_marks", "n_words"),
    }


def counts_of(raw: bytes) -> tuple[int, ...]:
    """COUNTS of one text's UTF-8 bytes; letters are the ASCII ones, marks the runs of `!`."""
    words = raw.split()  # bytes split at exactly the six ASCII blanks
    n = len(words)
    inside = len(raw) - sum(map(raw.count, (b"\x20", b"\x09", b"\x0a", b"\x0b", b"\x0c", b"\x0d")))
    chars = inside if raw.isascii() else inside - int(((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80).sum())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        m = len(ids)
        if m < n:
            two = np.unique(w[:-1] * m + w[1:], return_inverse=True)[1] if m > 2_000_000 else w[:-1] * m + w[1:]
            t = two[:-1] * m + w[2:]
            order = np.argsort(t, kind="stable")
            same = t[order[1:]] == t[order[:-1]]
            if same.any():
                hit = np.zeros(n, bool)
                found = np.concatenate([order[1:][same], order[:-1][same]])
                for k in range(3):
                    hit[found + k] = True
                repeated = int(hit.sum())
    letters = raw.translate(None, _NOT_UPPER), raw.translate(None, _NOT_LETTER)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(letters[0]), len(letters[1]), raw.count(b"!") - raw.count(b"!!")


_NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_NOT_LETTER = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and COUNTS of every text; kept columns with a name of COUNTS are replaced."""
    keep = [c for c in keep if c not in COUNTS and c != "text"]
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counts_of(t or b"") for t in b.column(0).cast(pa.large_binary()).to_pylist()]
            cols = zip(*got, strict=True) if got else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, pa.int64()) for c in cols)], [*keep, *COUNTS])

    return docs.select("text", *keep).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution, summed from its largest term on until the rest does not matter."""
    if k >= n:
        return 1.0
    upper = k >= n * p  # then the other tail is the short one
    i = k + 1 if upper else k
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while term > total * 1e-17 and 0 <= i <= n:
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p) if upper else i / (n - i + 1) * (1 - p) / p
        i += 1 if upper else -1
    return min(1.0, max(0.0, 1.0 - total if upper else total))


def _stratum(column: str) -> Column:
    """A stratum's name, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _rejected(hits: list[int], counts: list[int]) -> list[int]:
    """How many rows each step rejects, and all rows last; a row is rejected by the `hits` strictest steps."""
    out = [0] * (STEPS + 1)
    for h, n in zip(hits, counts, strict=True):
        for i in range(STEPS - h, STEPS + 1):
            out[i] += n
    return out


def _sides(tallies: pd.DataFrame) -> tuple[list[int], list[int]]:
    """_rejected of the good rows and of the others."""
    return tuple(_rejected(t.hits.tolist(), t["count"].tolist()) for t in (tallies[tallies.good], tallies[~tallies.good]))


def _sent(table: DataFrame) -> DataFrame:
    """table for a join with larger rows: broadcast if it has BROADCAST rows at most."""
    rows = table.limit(BROADCAST + 1).collect()
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)) if len(rows) <= BROADCAST else table


def learn(counted: DataFrame, good: Column, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, cut_<rule> ..): the cutoffs of every stratum that has any (its name by _stratum), null for a rule that stays off.

    counted: labelled rows with doc_id; `good` marks the documents that must not be rejected. A stratum's counts (rules x steps rows)
    go to one task, and any number of strata over all tasks.
    """
    by = measures()
    names = list(by)
    rows = counted.where(~base_failed()).select(_stratum(stratum).alias("stratum"), good.alias("good"), (fold(PROPOSE) == 0).alias("first"), *(m.alias(r) for r, m in by.items()))
    strata = rows.where("good").select("stratum").distinct().count()
    hits = lambda rule, cutoffs: F.size(F.filter(cutoffs, lambda c: F.col(rule) > c))
    paths, cuts = (", ".join(["stratum string", *(f"{kind}_{r} {t}" for r in by)]) for kind, t in (("path", "array<double>"), ("cut", "double")))

    def propose(t: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in names:
            yes, no = _sides(t[t.rule == r])
            cheap = [i for i in range(STEPS) if yes[i] <= risk / len(names) * yes[-1] and no[i] * yes[-1] > yes[i] * no[-1]]
            found.append(path(RANGE[r][0], path(*RANGE[r])[cheap[-1]]) if cheap else [])
        return pd.DataFrame([(t.stratum.iloc[0], *found)] if any(found) else [], columns=["stratum", *(f"path_{r}" for r in names)])

    def choose(t: pd.DataFrame) -> pd.DataFrame:
        (yes, no), best, at = _sides(t), 0.0, None
        for i in range(STEPS):  # the order is fixed beforehand, so only the strata need a correction
            if not yes[-1] or tail(yes[i], yes[-1], risk) > level / strata:
                break
            gain = no[i] / max(1, no[-1]) - yes[i] / yes[-1]
            if gain > best:
                best, at = gain, i
        one = t.iloc[0]
        found = [(one.stratum, *(one[f"path_{r}"][at] if len(one[f"path_{r}"]) else None for r in names))] if at is not None else []
        return pd.DataFrame(found, columns=["stratum", *(f"cut_{r}" for r in names)])

    tried = F.array(*(F.struct(F.lit(r).alias("rule"), hits(r, F.array(*map(F.lit, path(*RANGE[r])))).alias("hits")) for r in by))
    tallies = rows.where("first").select("stratum", "good", F.explode(tried).alias("t")).groupBy("stratum", "good", "t.rule", "t.hits").count()
    proposed = _sent(cut(tallies.groupBy("stratum").applyInPandas(propose, paths)))
    held = rows.where("not first").join(proposed, "stratum")
    tests = held.select("stratum", "good", F.greatest(*(hits(r, F.col(f"path_{r}")) for r in by)).alias("hits")).groupBy("stratum", "good", "hits").count()
    return cut(tests.join(proposed, "stratum").groupBy("stratum").applyInPandas(choose, cuts))


def judge(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang", name: str = "passed") -> DataFrame:
    """counted with `name`: true where no rule of the row's stratum rejects."""
    by = measures()
    own = _sent(cutoffs.withColumnRenamed("stratum", "_cut"))
    joined = counted.join(own, _stratum(stratum) == F.col("_cut"), "left")
    bad = F.lit(False)
    for r, m in by.items():
        bad = bad | F.coalesce(m > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn(name, ~bad).drop("_cut", *(f"cut_{r}" for r in by))


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document.

    Cutoffs are learned from the labelled documents: rows of labels with quality 1 are the good ones. A document with
    several label rows counts once and is good if any of them says so; null ids match nothing. kept is false if base_failed.
    """
    counted = cut(measure(docs, ["doc_id", stratum]))
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    labelled = cut(counted.withColumnRenamed(stratum, "_stratum").join(marked.withColumnRenamed("good", "_good"), "doc_id"))
    judged = judge(counted, learn(labelled, F.col("_good"), "_stratum", risk, level), stratum, "_passed")
    return judged.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), (~base_failed() & F.col("_passed")).alias("kept"), *COUNTS[5:])
