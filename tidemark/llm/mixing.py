"""Mixing sources to target weights with soft memberships, in DataFrame functions only.

A table classifier learns from labelled documents: the text's shape (shares of capitals, symbols, letters with marks that
are typical of a language, word length, size) is cut into bins, and a cell of bins has the smoothed shares of the domains
among its labelled documents as its posteriors. Each document's rate then is chosen so that the expected tokens of all domains
meet the targets: nonnegative rates r minimise the squared distance between A r and the target totals, where row d of A holds the
document's tokens times its posterior of domain d. Projected gradient steps need only the domain totals of each step; the
distance is measured in the metric of A's Gram matrix (as many rows as domains) over the documents that still have a rate, where a step of
length one is safe. A document's rate is a fold over the gradients so far and the same for all documents of one cell and size, so the
steps run over these groups and keep nothing per document. The sources mixed are the domains: the documents of one language, and those of
low quality; a label such as a crawl's name can be a domain as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize, release

#: Letters with marks that point to one language among those of Western Europe.
MARKS = {"german": "[äöüßÄÖÜ]", "french": "[èêëçàùûîôœÈÊÇÀ]", "spanish": "[ñóíáúÑ¿¡]"}
#: Descent ends when all totals are this near to the targets (in shares of all tokens), or when PATIENCE steps gain less than that of the
#: distance. The rates are those of the best step.
TOLERANCE = 1e-6
PATIENCE = 5
MOST_STEPS = 40
SMOOTHING = 4.0


def _bin(x: Column, edges: list[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + (x > e).cast("int")
    return out


def shape_cell(text: Column, tokens: Column) -> Column:
    """A small number for the shape of a text; the number of cells does not depend on the data."""
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    capitals = F.regexp_count(text, F.lit("[A-Z]")) / chars
    symbols = F.regexp_count(text, F.lit("[#$%&*|!<>=_{}]")) / chars
    marks = [F.regexp_count(text, F.lit(m)) / chars for m in MARKS.values()]
    top = F.greatest(*marks)
    language = F.when(top <= 0.002, 0)
    for i, m in enumerate(marks):
        language = language.when(m == top, i + 1)
    length = chars / F.greatest(tokens, F.lit(1))
    parts = [(_bin(capitals, [0.05, 0.3]), 3), (_bin(symbols, [0.005, 0.05]), 3), (F.coalesce(language, F.lit(0)), 4), (_bin(length, [4.5, 7.0]), 3), (_bin(tokens, [20, 200]), 3)]
    out = F.lit(0)
    for value, size in parts:
        out = out * size + value
    return out.cast("int")


def features(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """id, n_tokens and cell of each row (and the columns to ``keep``), without the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(f"__{c}") for c in keep or []), tokens.alias("n_tokens"), shape_cell(text, tokens).alias("cell"))


def posterior_table(feats: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """cell, p: smoothed domain shares of the labelled documents of each cell (one label per id: the smallest), and one row for cell -1, their overall shares."""
    known = labelled.where(F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    counts = feats.select("id", "cell").join(known, "id").groupBy("cell", "domain").count()
    per_cell = counts.groupBy("cell").agg(*(F.sum(F.when(F.col("domain") == d, F.col("count")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains)))
    total = per_cell.agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(domains))))
    all_n = sum((F.col(f"t{i}") for i in range(len(domains))), F.lit(0))
    prior = [(F.col(f"t{i}") + 1.0) / (all_n + float(len(domains))) for i in range(len(domains))]
    rows = per_cell.unionByName(per_cell.limit(0).unionByName(feats.sparkSession.range(1).select(F.lit(-1).alias("cell"), *(F.lit(0).cast("long").alias(f"n{i}") for i in range(len(domains))))))
    n = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    p = F.array(*[(F.col(f"n{i}") + SMOOTHING * prior[i]) / (n + SMOOTHING) for i in range(len(domains))])
    return rows.crossJoin(F.broadcast(total)).select("cell", p.alias("p"))


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination of one small system (as many rows as domains), with a light ridge."""
    n = len(b)
    scale = max(max(abs(v) for v in row) for row in a) or 1.0
    m = [[*row, y] for row, y in zip([r[:] for r in a], b, strict=True)]
    for i in range(n):
        m[i][i] += 1e-9 * scale
    for i in range(n):
        k = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[k] = m[k], m[i]
        for r in range(n):
            if r != i and m[i][i]:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] if m[i][i] else 0.0 for i in range(n)]


def _rate(history: list[list[float]]) -> Column:
    """The rate after the steps so far: from 1, less the document's share of each gradient, never below 0."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in history])
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with("x", g, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))


def fit_rates(rows: DataFrame, targets: list[float]) -> tuple[list[list[float]], list[float]]:
    """The gradients of all steps, and what each domain's total then has beyond its target. ``rows`` has x, a document's expected share of all tokens
    by domain, and m, the documents that have these shares; the targets are shares of all tokens.

    One job per step gives the totals and the Gram matrix of the documents whose rate is above zero: only these can still move, and in their metric
    a few steps are enough."""
    k = len(targets)
    history: list[list[float]] = []
    best, best_left, since = float("inf"), [], 0
    while True:
        x = rows.select(_rate(history).alias("r"), "x", "m")
        totals = [F.sum(F.col("m") * F.col("r") * F.col("x")[i]).alias(f"t{i}") for i in range(k)]
        pairs = [F.sum(F.when(F.col("r") > 0, F.col("m") * F.col("x")[i] * F.col("x")[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        got = x.agg(*totals, *pairs).first()
        left = [float(got[f"t{i}"] or 0.0) - targets[i] for i in range(k)]
        gram = [[float(got[f"g{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(k)] for i in range(k)]
        apart = sum(v * v for v in left) ** 0.5
        since = 0 if apart < best * (1 - TOLERANCE) else since + 1
        if apart < best:
            best, best_left, kept = apart, left, len(history)
        if max(abs(v) for v in left) <= TOLERANCE or since == PATIENCE or len(history) == MOST_STEPS:
            return history[:kept], best_left
        history.append(solve(gram, left))


def mix_to_targets(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source") -> DataFrame:
    """Rates that bring the expected domain tokens of a corpus to target weights.

    ``labelled`` has id and domain. Returns a row per input row: id, the source column (if given), n_tokens, cell, p_<domain> for the
    domains in order of name, rate >= 0, expected_tokens = rate * n_tokens, and residual: the largest difference, in shares of all tokens,
    that is left between a domain's expected tokens and its target (the same in all rows; above ``TOLERANCE`` no rates reach the targets). Weights are scaled to a sum of 1, and the expected tokens in
    total to those of the corpus. Domains without labelled documents have small posteriors everywhere; a target that no rates reach is
    met as near as possible. Null and empty texts have no tokens and rate 1. Rows that repeat an id each get a rate. Null ids stay null. Labels
    outside the targets are ignored; without labels all posteriors are equal. Other columns are ignored.
    """
    domains = sorted(targets)
    weight = sum(targets.values())
    keep = [source_col] if source_col else []
    feats = materialize(features(docs, id_col, text_col, keep), "features")
    table = materialize(posterior_table(feats, labelled, domains), "posteriors")
    prior = table.where("cell = -1").select(F.col("p").alias("prior"))
    # Both tables have a row per cell of bins at most.
    x = feats.join(F.broadcast(table), "cell", "left").crossJoin(F.broadcast(prior)).withColumn("p", F.coalesce("p", "prior")).drop("prior")
    tokens = feats.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first().n or 1
    x = x.withColumn("x", F.transform("p", lambda v: v * F.col("n_tokens") / F.lit(float(tokens))))
    # Documents of one cell and size have one rate: the descent runs over these groups.
    alike = materialize(x.groupBy("cell", "n_tokens").agg(F.count(F.lit(1)).alias("m"), F.first("x").alias("x")), "mixing")
    history, left = fit_rates(alike, [targets[d] / weight for d in domains])
    release(alike)
    rate = _rate(history)
    return x.select(
        F.col("id").alias(id_col),
        *(F.col(f"__{c}").alias(c) for c in keep),
        "n_tokens",
        "cell",
        *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)),
        rate.alias("rate"),
        (rate * F.col("n_tokens")).alias("expected_tokens"),
        F.lit(max(abs(v) for v in left)).alias("residual"),
    )
