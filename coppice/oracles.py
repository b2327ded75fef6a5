"""Boosted trees and special functions as DuckDB SQL, written from the formulas, to hold the models against."""

from __future__ import annotations


def digamma_sql(x: str) -> str:
    """Twenty steps of the recurrence, then the asymptotic series."""
    z = f"({x} + 20.0)"
    return f"(ln{z} - 0.5 / {z} - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - list_sum(list_transform(range(20), lambda k: 1.0 / ({x} + k))))"


def trigamma_sql(x: str) -> str:
    z = f"({x} + 20.0)"
    return f"(1 / {z} + 0.5 / {z} ** 2 + 1 / (6 * {z} ** 3) - 1 / (30 * {z} ** 5) + list_sum(list_transform(range(20), lambda k: 1.0 / ({x} + k) ** 2)))"


def normal_cdf_sql(z: str) -> str:
    """1/2 plus the density's power series, which converges fast within six deviations; 0 or 1 beyond."""
    series = f"list_sum(list_transform(range(120), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-12)) - list_sum(list_transform(range(k + 1), lambda j: ln(2 * j + 1.0))))))"
    half = f"exp(-0.5 * ({z}) ** 2) / sqrt(2 * pi()) * {series}"
    return f"(CASE WHEN {z} > 6 THEN 1.0 WHEN {z} < -6 THEN 0.0 ELSE 0.5 + sign({z}) * {half} END)"


def _bins(source: str, features: list[str], texts: list[str], n_bins: int) -> str:
    """e: edges of the numeric features; r: rows (rid, every column of source, b0, b1, ...), 0 and up."""
    points = ", ".join(repr(i / n_bins) for i in range(1, n_bins))
    numeric = [f for f in features if f not in texts]
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({f}, [{points}]))) AS e_{f}" for f in numeric)
    at = [f"(dense_rank() OVER (ORDER BY {f}) - 1)" if f in texts else f"least(len(list_filter(e_{f}, lambda q: q <= {f})), len(e_{f}) - 1)" for f in features]
    return f"src AS MATERIALIZED ({source}), e AS MATERIALIZED (SELECT {edges} FROM src),\nr AS MATERIALIZED (SELECT row_number() OVER () AS rid, src.*, {', '.join(f'{x} AS b{i}' for i, x in enumerate(at))} FROM src, e)"


def boosting_sql(source: str, features: list[str], base: list[str], gradients: list[tuple[str, str]], n_trees: int, max_depth: int, rate: float = 0.1, texts: tuple[str, ...] = (), n_bins: int = 254, symmetric: bool = False, reg_lambda: float = 1.0) -> str:
    """CTEs of an ensemble grown level by level on the rows of source (a SELECT of the features and y).

    base: the first raw score of each output, p0, p1, ...; gradients: (g, h) of each output in terms of these and y.
    texts: categorical features. Ends with `model`: the rows with their final scores; `splits` holds (feature) of all splits.
    """
    outs, lam = range(len(base)), reg_lambda
    parts = [_bins(source, features, list(texts), n_bins)]
    parts.append(f"s0 AS MATERIALIZED (SELECT *, {', '.join(f'({b})::DOUBLE AS p{k}' for k, b in enumerate(base))} FROM r)")
    splits = []
    score = lambda g, h: f"({g}) * ({g}) / ({h} + {lam})"
    for t in range(n_trees):
        ghs = ", ".join(f"({g})::DOUBLE AS g{k}, ({h})::DOUBLE AS h{k}, 0 AS n{k}" for k, (g, h) in enumerate(gradients))
        now = f"t{t}_0"
        parts.append(f"{now} AS MATERIALIZED (SELECT *, {ghs} FROM s{t})")
        for d in range(max_depth):
            for k in outs:
                at = f"t{t}_{d}_{k}"
                flat = " UNION ALL ".join(f"SELECT n{k} AS node, {i} AS feature, b{i} AS bin, sum(g{k}) AS g, sum(h{k}) AS h FROM {now} GROUP BY ALL" for i in range(len(features)))
                order = "bin::DOUBLE" if not texts else f"CASE WHEN feature IN ({', '.join(str(features.index(f)) for f in texts)}) THEN -g / (h + {lam}) ELSE bin END"
                within = "PARTITION BY node, feature ORDER BY o, bin ROWS UNBOUNDED PRECEDING"
                parts.append(f"h{at} AS MATERIALIZED (SELECT *, {order} AS o, sum(g) OVER (PARTITION BY node, feature) AS tg, sum(h) OVER (PARTITION BY node, feature) AS th FROM ({flat}))")
                if symmetric:
                    # every node has a prefix at every bin that any node of the level has
                    parts.append(f"""c{at} AS MATERIALIZED (SELECT g.node, g.feature, g.bin, g.tg, g.th, sum(coalesce(x.g, 0)) OVER w AS gl, sum(coalesce(x.h, 0)) OVER w AS hl
FROM (SELECT DISTINCT a.node, a.feature, b.bin, a.tg, a.th FROM h{at} a JOIN (SELECT DISTINCT feature, bin FROM h{at}) b USING (feature)) g
LEFT JOIN h{at} x ON x.node = g.node AND x.feature = g.feature AND x.bin = g.bin WINDOW w AS (PARTITION BY g.node, g.feature ORDER BY g.bin ROWS UNBOUNDED PRECEDING))""")
                    gain = f"{score('gl', 'hl')} + {score('tg - gl', 'th - hl')} - {score('tg', 'th')}"
                    one = f"SELECT feature, bin FROM (SELECT feature, bin, sum(CASE WHEN hl >= 1 AND th - hl >= 1 THEN {gain} ELSE 0 END) AS gain FROM c{at} GROUP BY ALL) WHERE gain > 0 ORDER BY round(gain, 8) DESC, feature, bin LIMIT 1"
                    parts.append(f"best{at} AS MATERIALIZED (SELECT n.node, f.feature, range(f.bin + 1) AS codes FROM (SELECT DISTINCT node FROM h{at}) n, ({one}) f)")
                else:
                    parts.append(f"c{at} AS MATERIALIZED (SELECT *, sum(g) OVER ({within}) AS gl, sum(h) OVER ({within}) AS hl, list(bin) OVER ({within}) AS codes FROM h{at})")
                    gain = f"{score('gl', 'hl')} + {score('tg - gl', 'th - hl')} - {score('tg', 'th')}"
                    parts.append(f"best{at} AS MATERIALIZED (SELECT node, feature, codes FROM (SELECT *, {gain} AS gain FROM c{at} WHERE hl >= 1 AND th - hl >= 1) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 8) DESC, feature, o, bin) = 1)")
                splits.append(f"SELECT feature FROM best{at}")
            bin_of = "CASE {a}.feature " + " ".join(f"WHEN {i} THEN x.b{i}" for i in range(len(features))) + " END"
            for k in outs:  # one output after another: DuckDB plans a join of all of them badly
                step = f"CASE WHEN a.feature IS NULL THEN x.n{k} WHEN list_contains(a.codes, {bin_of.format(a='a')}) THEN 2 * x.n{k} + 1 ELSE 2 * x.n{k} + 2 END AS n{k}"
                parts.append(f"t{t}_{d + 1}m{k} AS MATERIALIZED (SELECT x.* REPLACE ({step}) FROM {now} x LEFT JOIN bestt{t}_{d}_{k} a ON a.node = x.n{k})")
                now = f"t{t}_{d + 1}m{k}"
        new = ", ".join(f"p{k} + {rate} * (-sum(g{k}) OVER (PARTITION BY n{k}) / (sum(h{k}) OVER (PARTITION BY n{k}) + {lam})) AS p{k}" for k in outs)
        drop = ", ".join(f"g{k}, h{k}, n{k}" for k in outs)
        parts.append(f"s{t + 1} AS MATERIALIZED (SELECT * EXCLUDE ({drop}) REPLACE ({new}) FROM {now})")
    parts.append(f"model AS (SELECT * FROM s{n_trees})")
    parts.append(f"splits AS ({' UNION ALL '.join(splits)})")
    return "WITH " + ",\n".join(parts)
