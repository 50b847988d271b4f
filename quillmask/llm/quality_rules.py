"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns (3 ** 7 at most) estimates
how often a good and a bad document get each vote from each rule; a document's verdict is its posterior probability of being good.
The whole fit is one expression over one row; the model is 43 numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import WORD, keep, settled, written

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it for on was be with as this by at are from an not or have has "
    "de la le les des et du est pas dans pour qui sur une un que en au par avec "
    "der die und den das zu von ist mit dem im ein eine nicht auf für sich "
    "el los del se las por con una su para es al lo como y"
).split()
#: Rule -> (bad if, good if); neither: the rule abstains.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "duplicate_lines": ("10 * n_dup_lines > 4 * n_lines", "n_lines >= 3 AND 10 * n_dup_lines <= n_lines"),
    "repetition": ("100 * n_repeat_words > 45 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "word_length": ("10 * word_chars < 33 * n_words OR word_chars > 10 * n_words", "word_chars >= 4 * n_words AND word_chars <= 7 * n_words"),
    "function_words": ("100 * n_function_words < n_words", "100 * n_function_words >= 6 * n_words"),
    "capitals": ("10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    "exclamations": ("5 * n_exclamations > n_words", "20 * n_exclamations <= n_words"),
}
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_function_words", "n_capitals", "n_exclamations")
#: Votes (bad, none, good) that a good and a bad document get before any data, and how many documents these count as.
GOOD_START, BAD_START, PRIOR, WEIGHT = (0.05, 0.25, 0.7), (0.3, 0.3, 0.4), 0.8, 4.0
ITERATIONS = 30
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the SIGNALS of a text column, as bigints; a null text has none of anything. Columns of these names are replaced."""
    t, w = "__text", "__words"
    count = lambda regex: F.regexp_count(F.col(t), F.lit(regex)).cast("bigint")
    d = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    bare = F.btrim(F.col(t), F.lit(BLANK))
    d = d.withColumn(w, F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    d = d.withColumn("__lines", lines).withColumn("n_words", F.size(w).cast("bigint"))
    windows = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__windows", windows)
    # sorting is for texts with a repeated window only
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    d = d.withColumn("__sorted", F.when(repeated, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("__sorted", lambda x, k: (x["h"] == F.get("__sorted", k - 1)["h"]) | (x["h"] == F.get("__sorted", k + 1)["h"]))
    d = d.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    d = d.withColumns(
        {
            "word_chars": F.length(t) - count(r"[\x20\x09-\x0D]"),
            "n_symbols": count(f"[{SYMBOLS}]"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_function_words": F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS))).cast("bigint"),
            "n_capitals": count("[A-ZÀ-ÏÑ-ÖØ-Ý]"),  # UPPER
            "n_exclamations": count("!"),
        }
    )
    return settled(d.drop(t, w, "__lines", "__windows", "__sorted", "__at"))


def votes() -> Column:
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for bad, good in RULES.values()])


@dataclass(frozen=True)
class Model:
    """prior: P(good); good[3 * rule + vote + 1], bad[...]: P(vote | class)."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self) -> Column:
        odds = F.lit(log(self.prior / (1 - self.prior)))
        for j, (bad, good) in enumerate(RULES.values()):
            weight = [log(self.good[3 * j + v] / self.bad[3 * j + v]) for v in range(3)]
            odds = odds + F.expr(f"CASE WHEN {bad} THEN {weight[0]!r}D WHEN {good} THEN {weight[2]!r}D ELSE {weight[1]!r}D END")
        return 1 / (1 + F.exp(-odds))


def fit(signals: DataFrame) -> Model:
    """EM over the vote patterns of all rows with SIGNALS. No rows: the starting values."""
    patterns = signals.groupBy(votes().alias("v")).agg(F.count("*").alias("n"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("p"))
    m = len(RULES)
    start = lambda s: ", ".join(f"{x!r}D" for _ in range(m) for x in s)
    odds = f"aggregate(sequence(0, {m - 1}), ln(s.prior / (1 - s.prior)), (a, j) -> a + ln(s.good[3 * j + x.v[j] + 1] / s.bad[3 * j + x.v[j] + 1]))"
    scored = f"transform(p, x -> named_struct('v', x.v, 'n', x.n, 'w', 1 / (1 + exp(-({odds})))))"
    total = lambda what: f"aggregate(e, 0D, (a, x) -> a + {what})"
    share = lambda w, s: f"transform(sequence(0, {3 * m - 1}), k -> ({total(f'IF(x.v[k div 3] = k % 3 - 1, x.n * {w}, 0D)')} + {WEIGHT!r}D * array({start(s)})[k]) / ({total(f'x.n * {w}')} + {WEIGHT!r}D))"
    bad = "(1 - x.w)"
    prior = f"({total('x.n * x.w')} + {WEIGHT * PRIOR!r}D) / ({total('x.n')} + {WEIGHT!r}D)"
    step = f"transform(array({scored}), e -> named_struct('prior', {prior}, 'good', {share('x.w', GOOD_START)}, 'bad', {share(bad, BAD_START)}))[0]"
    first = f"named_struct('prior', {PRIOR!r}D, 'good', array({start(GOOD_START)}), 'bad', array({start(BAD_START)}))"
    s = one.select(F.expr(f"aggregate(sequence(1, {ITERATIONS}), {first}, (s, i) -> {step})").alias("s")).head()["s"]
    return Model(s["prior"], tuple(s["good"]), tuple(s["bad"]))


def judge(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, SIGNALS, posterior, base_failed, kept; one row for each row of docs.

    base_failed: under 50 words, or over half of them in repeated windows of three. kept: not base_failed and a posterior of at least
    0.5 under the model fitted to all rows. Null and empty texts fail. Equal texts get equal verdicts; doc_ids may be null or repeat.
    """
    rows = keep(with_signals(docs.select("doc_id", F.col("text").alias("__t")), "__t").select("doc_id", *SIGNALS))
    failed = F.expr(BASE_FAILED)
    p = fit(rows).posterior()
    return rows.select("doc_id", *SIGNALS, p.alias("posterior"), failed.alias("base_failed"), (~failed & (p >= 0.5)).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns. No shuffle of texts: one scan computes all signals and writes them beside
    the rows, the fit reads the signals, the filter both. Names that begin with two underscores are reserved."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__t"))
    rows = written(with_signals(rows, "__t").select("__row", F.struct(*SIGNALS).alias("__signals")), "quality-signals")
    model = fit(rows.select("__signals.*"))
    return rows.select("__row", "__signals.*").where(~F.expr(BASE_FAILED) & (model.posterior() >= 0.5)).select("__row.*")


def _oracle() -> str:
    words = "', '".join(FUNCTION_WORDS)
    blank = r"[\x20\x09-\x0D]"
    n, names = len(RULES), list(RULES)
    vote = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v{j}" for j, (b, g) in enumerate(RULES.values()))
    cells = [(c, j, v) for c in "gb" for j in range(n) for v in range(3)]
    start = ", ".join([f"{PRIOR!r}::DOUBLE AS prior"] + [f"{(GOOD_START if c == 'g' else BAD_START)[v]!r}::DOUBLE AS {c}{j}_{v}" for c, j, v in cells])
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"ln(CASE v{j} WHEN -1 THEN g{j}_0 / b{j}_0 WHEN 0 THEN g{j}_1 / b{j}_1 ELSE g{j}_2 / b{j}_2 END)" for j in range(n))
    post = f"1 / (1 + exp(-({odds})))"
    share = lambda c, j, v: f"(sum(CASE WHEN v{j} = {v - 1} THEN n * {'w' if c == 'g' else '(1 - w)'} ELSE 0 END) + {WEIGHT * (GOOD_START if c == 'g' else BAD_START)[v]!r}) / (sum(n * {'w' if c == 'g' else '(1 - w)'}) + {WEIGHT!r}) AS {c}{j}_{v}"
    steps = [f"m0 AS MATERIALIZED (SELECT {start})"]
    for i in range(1, ITERATIONS + 1):
        sums = ", ".join([f"(sum(n * w) + {WEIGHT * PRIOR!r}) / (sum(n) + {WEIGHT!r}) AS prior"] + [share(*c) for c in cells])
        steps.append(f"m{i} AS MATERIALIZED (SELECT {sums} FROM (SELECT p.*, {post} AS w FROM p, m{i - 1}))")
    assert len(names) == n
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM l WHERE len(w) >= 3),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
x AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE c.n > 1 GROUP BY r),
s AS (SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{blank}', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(x.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(list_filter(w, lambda y: y IN ('{words}')))::BIGINT AS n_function_words,
  (length(text) - length(translate(text, '{UPPER}', '')))::BIGINT AS n_capitals, (length(text) - length(translate(text, '!', '')))::BIGINT AS n_exclamations
  FROM l LEFT JOIN x USING (r)),
p AS MATERIALIZED (SELECT {vote}, count(*)::DOUBLE AS n FROM s GROUP BY ALL),
{", ".join(steps)},
z AS (SELECT s.*, {vote}, m.* FROM s, m{ITERATIONS} m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
  (NOT ({BASE_FAILED}) AND {post} >= 0.5) AS kept FROM z
"""


ORACLE_SQL = _oracle()
