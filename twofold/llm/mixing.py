"""Mixing to target weights by iterative proportional fitting (operator 10).

Token weights are summed into cells (source, language, topic); raking scales the expected kept tokens of
the cells to each marginal's target in turn, never above what a cell has, for a fixed number of rounds.
Expected over present tokens is the cell's probability, and a document stays where a hash of its id, even
over 0 to 1, lies under it. Only cells are gathered: on the driver while their number is within
MAX_DRIVER_CELLS, else in DataFrame rounds that give the same numbers.

Defined results: a null source, language or topic is the value "unknown"; a null or empty text has no
tokens and weighs nothing, its cell's probability holds for it all the same (0 in a cell without tokens);
rows with one id are kept or dropped together, a null id counts as an empty one; cells of equal tokens are told apart by
their values; very long texts weigh all their words; an empty table gives an empty result. Other columns pass through whatever
their names; one that is named like a column the operator adds (ADDED) gives way to it. With given targets, a value
that a marginal's targets don't name has target 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twofold.llm.common import drop_written, written

ROUNDS = 12
TEMPERATURE = 0.5
RATE = 0.5
SEED = 20
MAX_DRIVER_CELLS = 50_000
DIMS = ("source", "lang", "topic")
ADDED = ("_cell", "_tokens", "_probability", "_sampled")


def n_words(text: str = "text") -> F.Column:
    """Words of a text: runs of other characters than space and \\x09-\\x0D."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def text_form(text: str = "text") -> F.Column:
    """Topic of a document where none is given: the form of its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.length(t)
    symbols = size - F.length(F.translate(t, "#*$%&<>", ""))
    pipes = size - F.length(F.translate(t, "|", ""))
    return (
        F.when(pipes * 100 > size, "table").when(symbols * 100 > size, "code")
        .when(size < 600, "note").when(size < 6000, "page").otherwise("long")
    )


def with_cells(docs: DataFrame, topic: F.Column) -> DataFrame:
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.select(
        "*",
        F.struct(named(F.col("source")).alias("source"), named(F.col("lang")).alias("lang"), named(topic).alias("topic")).alias("_cell"),
        n_words().alias("_tokens"),
    )


def tempered(share: np.ndarray) -> np.ndarray:
    out = share**TEMPERATURE
    return out / out.sum() if out.sum() else out


def rake(cells: list[tuple], targets: dict[str, dict[str, float]] | None, rate: float, rounds: int) -> np.ndarray:
    """Probability of each cell (source, lang, topic, tokens)."""
    have = np.array([c[3] for c in cells], dtype=np.float64)
    kept, total = have * rate, have.sum()
    groups = []
    for d, dim in enumerate(DIMS):
        values, of = np.unique([c[d] for c in cells], return_inverse=True)
        share = np.bincount(of, have) / max(total, 1.0)
        given = (targets or {}).get(dim)
        want = np.array([given.get(v, 0.0) for v in values]) if given else tempered(share)
        groups.append((of, want * rate * total))
    for _ in range(rounds):
        for of, want in groups:
            now = np.bincount(of, kept, minlength=len(want))
            kept = np.minimum(kept * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[of], have)
    return np.divide(kept, have, out=np.zeros_like(have), where=have > 0)


def rake_frame(cells: DataFrame, targets: dict[str, dict[str, float]] | None, rate: float, rounds: int) -> DataFrame:
    """`rake` for more cells than the driver may hold: the same rounds as DataFrame steps."""
    now = written(cells.withColumn("kept", F.col("tokens") * rate), "cells")
    total = now.agg(F.sum("tokens")).first()[0] or 0
    for _ in range(rounds):
        step = now
        for dim in DIMS:
            by = Window.partitionBy(dim)
            given = (targets or {}).get(dim)
            have = step.groupBy(dim).agg(F.sum("tokens").alias("t"))
            if given:
                pairs = F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))])
                want = have.select(F.col(dim).alias("v"), (F.coalesce(pairs[F.col(dim)], F.lit(0.0)) * rate * total).alias("want"))
            else:
                all_of = have.agg(F.sum(F.pow(F.col("t") / max(total, 1), F.lit(TEMPERATURE)))).first()[0] or 1.0
                want = have.select(F.col(dim).alias("v"), (F.pow(F.col("t") / max(total, 1), F.lit(TEMPERATURE)) / all_of * rate * total).alias("want"))
            sums = F.sum("kept").over(by)
            step = (
                step.withColumn("_now", sums).join(want, F.col(dim) == F.col("v")).drop("v")
                .withColumn("kept", F.least(F.when(F.col("_now") > 0, F.col("kept") * (F.col("want") / F.col("_now"))).otherwise(0.0), F.col("tokens").cast("double")))
                .drop("_now", "want")
            )
        nxt = written(step, "cells")
        drop_written(now)
        now = nxt
    return now.select("source", "lang", "topic", F.when(F.col("tokens") > 0, F.col("kept") / F.col("tokens")).otherwise(0.0).alias("probability"))


def uniform(id_col: str = "doc_id", seed: int = SEED) -> F.Column:
    """A number in [0, 1) that only the id and the seed decide: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, topic: F.Column | None = None, targets: dict[str, dict[str, float]] | None = None, rate: float = RATE,
    rounds: int = ROUNDS, id_col: str = "doc_id", max_driver_cells: int = MAX_DRIVER_CELLS,
) -> DataFrame:
    """The documents with `_cell`, `_tokens`, `_probability` and `_sampled`; targets default to tempered shares."""
    spark = docs.sparkSession
    celled = with_cells(docs.drop(*ADDED), text_form() if topic is None else topic)
    sums = celled.groupBy("_cell").agg(F.sum("_tokens").alias("tokens")).select("_cell.*", "tokens")
    cells = written(sums, "cells")
    if cells.count() <= max_driver_cells:
        rows = sorted(tuple(r) for r in cells.select(*DIMS, "tokens").collect())
        p = rake(rows, targets, rate, rounds) if rows else []
        found = spark.createDataFrame(
            [(*r[:3], float(x)) for r, x in zip(rows, p, strict=True)], "source string, lang string, topic string, probability double"
        )
        found = F.broadcast(found)  # at most max_driver_cells rows
    else:
        found = rake_frame(cells, targets, rate, rounds)
    found = found.select(F.struct("source", "lang", "topic").alias("_cell"), F.col("probability").alias("_probability"))
    return celled.join(found, "_cell").withColumn("_sampled", uniform(id_col) < F.col("_probability"))


def mix_sql(rate: float = RATE, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The raking and the sampling in DuckDB SQL."""
    steps, last = [], "s0"
    for k in range(rounds * len(DIMS)):
        dim = DIMS[k % len(DIMS)]
        steps.append(
            f"s{k + 1} as materialized (select source, lang, topic, tokens, w_source, w_lang, w_topic, "
            f"least(case when sum(kept) over (partition by {dim}) > 0 then kept * (w_{dim} / sum(kept) over (partition by {dim})) else 0.0 end, tokens::double) as kept from s{k})"
        )
        last = f"s{k + 1}"
    wants = ", ".join(
        f"want_{d} as (select {d}, pow(t / total, {TEMPERATURE}) / sum(pow(t / total, {TEMPERATURE})) over () * {rate} * total as w_{d} from "
        f"(select {d}, sum(tokens)::double as t, (select greatest(sum(tokens), 1)::double from cells) as total from cells group by 1))"
        for d in DIMS
    )
    return f"""
with docs as (
  select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, coalesce(text, '') as t,
         length(t) as n, length(t) - length(translate(t, '#*$%&<>', '')) as symbols, length(t) - length(translate(t, '|', '')) as pipes,
         case when pipes * 100 > n then 'table' when symbols * 100 > n then 'code' when n < 600 then 'note' when n < 6000 then 'page' else 'long' end as topic,
         len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as n_tokens
  from documents),
cells as materialized (select source, lang, topic, sum(n_tokens)::bigint as tokens from docs group by all),
{wants},
s0 as materialized (select source, lang, topic, tokens, w_source, w_lang, w_topic, tokens * {rate} as kept
       from cells join want_source using (source) join want_lang using (lang) join want_topic using (topic)),
{", ".join(steps)},
p as (select source, lang, topic, case when tokens > 0 then kept / tokens else 0.0 end as probability from {last})
select doc_id, source, lang, topic, n_tokens::bigint as n_tokens, round(probability, 6) as probability,
       ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {float(1 << 52)!r} < probability as sampled
from docs join p using (source, lang, topic)
"""
