"""Quality rules by document and by host, in DataFrame expressions alone.

Each document gets counts and rule failures of its whole text. A host's (here: source's) failure rate of each rule is
shrunk towards the mean of the hosts' rates with a beta prior fitted to these rates by their moments, less what sampling adds
to them, so that hosts of few documents aren't judged by chance and the prior doesn't gain weight with others' documents. A host fails when a shrunk rate exceeds MOST; its verdict is joined back to its
documents. Counts are summed per task before they are dealt out, and a host's verdict is joined with salts, so that one
host may have any share of the rows.

Null texts: no words, so the rule of least words fails. Null hosts: judged by their text alone. Repeated rows are rows
like others; an empty table gives no rows. Input columns named like the outputs are replaced, others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import fresh, salt_copies, salted

LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES = 10, 20, 10, 30
#: A host fails where a rule's shrunk failure rate is above this.
MOST = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
SALTS = 16
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeated": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {MOST_SYMBOLS} * word_chars",
    "dup_lines": f"100 * n_dup_lines > {MOST_DUP_LINES} * n_lines",
}
# The white space between words, and the symbols that are counted.
SPACE = " \\t\\n\\u000b\\u000c\\r"
SYMBOLS = "#*$%&|<>"


#: The columns that features() and judged() make.
MADE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed of their texts.

    n_repeat_words counts the words within five-word windows that the text has twice or more. Windows are compared by
    64-bit hashes of their words. A text without a repeated window is told by its count of distinct hashes; only others
    are sorted.
    """
    docs = docs.drop(*MADE[:-2])
    _text, _words, _lines, _windows = fresh(docs, "text_", "words_", "lines_", "windows_")
    df = docs.withColumn(_text, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(_words, F.expr(f"array_remove(split(translate({_text}, '{SPACE}', '      '), ' '), '')"))
    df = df.withColumn(_lines, F.expr(f"filter(split({_text}, '\\n'), x -> length(btrim(x, '{SPACE}')) > 0)"))
    df = df.select(
        *[f"`{c}`" for c in docs.columns],
        F.expr(f"cast(size({_words}) as bigint)").alias("n_words"),
        F.expr(f"cast(length(translate({_text}, '{SPACE}', '')) as bigint)").alias("word_chars"),
        F.expr(f"cast(length({_text}) - length(translate({_text}, '{SYMBOLS}', '')) as bigint)").alias("n_symbols"),
        F.expr(f"cast(size({_lines}) as bigint)").alias("n_lines"),
        F.expr(f"cast(size({_lines}) - size(array_distinct({_lines})) as bigint)").alias("n_dup_lines"),
        F.expr(f"case when size({_words}) >= 5 then transform(sequence(0, size({_words}) - 5), i -> xxhash64({_words}[i], {_words}[i + 1], {_words}[i + 2], {_words}[i + 3], {_words}[i + 4])) else array() end").alias(_windows),
    )
    # A lambda over a one-element array names a value that is used more than once.
    repeated = f"transform(array(array_sort(transform({_windows}, (h, i) -> struct(h, i)))), s -> array_sort(transform(filter(s, (e, k) -> (k > 0 and get(s, k - 1).h = e.h) or get(s, k + 1).h = e.h), e -> e.i)))[0]"
    covered = f"transform(array({repeated}), p -> aggregate(transform(p, (x, k) -> least(5, coalesce(get(p, k + 1) - x, 5))), 0L, (a, x) -> a + x))[0]"
    df = df.withColumn("n_repeat_words", F.expr(f"case when size(array_distinct({_windows})) = size({_windows}) then 0L else {covered} end"))
    return df.drop(_windows).withColumn("base_failed", F.expr(f"{RULES['short']} or {RULES['repeated']}"))


def host_verdicts(rows: DataFrame, host: str = "source") -> DataFrame:
    """One row per host (nulls left out): n_docs, the shrunk rate of each rule, and host_failed. rows: what features() gives."""
    named = [F.sum(F.expr(rule).cast("long")).alias(f"f_{n}") for n, rule in RULES.items()]
    hosts = rows.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), *named)
    # A host weighs 1 - 1 / n_docs, so never more than 1, and its sampling variance is taken off.
    means = [F.expr(f"coalesce(try_divide(sum((1 - 1 / n_docs) * f_{n} / n_docs), sum(1 - 1 / n_docs)), sum(f_{n}) / sum(n_docs))").alias(f"m_{n}") for n in RULES]
    hosts = hosts.join(F.broadcast(hosts.agg(*means)))  # one row
    between = [F.expr(f"try_divide(sum((1 - 1 / n_docs) * (pow(f_{n} / n_docs - m_{n}, 2) - m_{n} * (1 - m_{n}) / n_docs)), sum(pow(1 - 1 / n_docs, 2) * m_{n} * (1 - m_{n})))").alias(f"s_{n}") for n in RULES]
    hosts = hosts.join(F.broadcast(hosts.agg(*between)))  # one row
    for n in RULES:
        weight = f"greatest({LEAST_WEIGHT}D, least({MOST_WEIGHT}D, case when s_{n} > 0 then 1 / s_{n} - 1 else {MOST_WEIGHT}D end))"
        hosts = hosts.withColumn(f"rate_{n}", F.expr(f"(f_{n} + m_{n} * {weight}) / (n_docs + {weight})"))
    return hosts.select("host", "n_docs", *[f"rate_{n}" for n in RULES], F.expr(" or ".join(f"rate_{n} > {MOST}" for n in RULES)).alias("host_failed"))


def judged(rows: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """rows (of features()) with host_failed and kept."""
    rows = rows.drop("host_failed", "kept")
    salt, of, known, bad = fresh(rows, "salt", "of", "known", "bad")
    few = salt_copies(verdicts.filter("host_failed").select(F.col("host").alias(of), F.lit(True).alias(bad)), SALTS, known)
    joined = salted(rows, SALTS, salt).join(few, (F.col(host) == F.col(of)) & (F.col(salt) == F.col(known)), "left")
    joined = joined.select(*[f"`{c}`" for c in rows.columns], F.coalesce(bad, F.lit(False)).alias("host_failed"))
    return joined.withColumn("kept", F.expr("not base_failed and not host_failed"))


def _oracle() -> str:
    space = r"[^\x20\x09-\x0D]"
    mean = {n: f"(all_{n} / all_docs)" for n in RULES}
    weight = {n: f"greatest({LEAST_WEIGHT}, least({MOST_WEIGHT}, coalesce(case when v_{n} = 0 then null else {mean[n]} * (1 - {mean[n]}) / v_{n} end - 1, {MOST_WEIGHT})))" for n in RULES}
    return f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{space}+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) as lines from d),
p as (select rid, unnest(range(1, len(words) - 3)) as pos, words from w where len(words) >= 5),
g as (select rid, pos, count(*) over (partition by rid, words[pos:pos + 4]) as n from p),
c as (select rid, least(5, coalesce(lead(pos) over (partition by rid order by pos) - pos, 5)) as k from g where n > 1),
r as (select rid, cast(sum(k) as bigint) as n_repeat_words from c group by rid),
f as (select doc_id, source, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (rid)),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from f),
h as (select source as host, count(*) as n_docs, {', '.join(f'sum(cast({rule} as bigint)) as f_{n}' for n, rule in RULES.items())} from b where source is not null group by source),
a as (select sum(n_docs) as all_docs, {', '.join(f'sum(f_{n}) as all_{n}' for n in RULES)} from h),
v as (select {', '.join(f'sum(n_docs * pow(f_{n} / n_docs - {mean[n]}, 2) / all_docs) as v_{n}' for n in RULES)} from h, a),
s as (select host, {' or '.join(f'(f_{n} + {mean[n]} * {weight[n]}) / (n_docs + {weight[n]}) > {MOST}' for n in RULES)} as host_failed from h, a, v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(host_failed, false) as kept
from b left join s on b.source = s.host"""


ORACLE = _oracle()
