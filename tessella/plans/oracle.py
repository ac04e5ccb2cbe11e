"""The same queries as SQL over the plain tables, for an independent engine."""

from __future__ import annotations

from tessella.plans.catalog import BIAS, KERNEL, LOOP, LOOP_ROUNDS, LOOP_STOP, WEIGHTS
from tessella.sources.fixtures import BANDS

OPT = """opt AS (SELECT o_orderkey AS idx, o_orderkey // 50 AS "row", o_orderkey % 50 AS col, CAST(o_totalprice AS DOUBLE) AS b0,
 CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS b1, CAST(o_custkey AS DOUBLE) AS b2,
 CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS b3 FROM orders)"""
SIZE = "g AS (SELECT max(\"row\") + 1 AS h, 50 AS w FROM opt)"
LIDAR = "lid AS (SELECT l_orderkey AS idx, max(l_quantity) AS l0, max(l_tax) AS l1 FROM lineitem GROUP BY 1)"
ALIGNED = 'al AS (SELECT opt.*, coalesce(l0, 0.0) AS l0, coalesce(l1, 0.0) AS l1 FROM opt LEFT JOIN lid USING (idx))'
TRI = """tri AS (SELECT s_suppkey AS pid, (s_suppkey * 13) % 50 AS x, (s_suppkey * 37) % h AS y FROM supplier, g)"""
EDGES = """corner AS (SELECT pid, 0 AS nth, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM tri UNION ALL SELECT pid, 1, x + 9, y + 2 FROM tri
 UNION ALL SELECT pid, 2, x + 3, y + 11 FROM tri),
side AS (SELECT a.pid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.pid = b.pid AND b.nth = (a.nth + 1) % 3)"""
BURN = """hit AS (SELECT DISTINCT idx FROM (SELECT idx, pid FROM opt JOIN side ON ((y1 > "row" + 0.5::DOUBLE) <> (y2 > "row" + 0.5::DOUBLE))
 AND col + 0.5::DOUBLE < (x2 - x1) * ("row" + 0.5::DOUBLE - y1) / (y2 - y1) + x1 GROUP BY idx, pid HAVING count(*) % 2 = 1))"""
LABEL = 'lab AS (SELECT opt.*, CASE WHEN hit.idx IS NULL THEN 0 ELSE 1 END AS y FROM opt LEFT JOIN hit USING (idx))'


def windows(step: int = 8) -> str:
    return f"""rowsw AS (SELECT wr FROM g, LATERAL (SELECT unnest(generate_series(0, (h - 16) // {step})) AS wr)),
colsw AS (SELECT unnest(generate_series(0, (50 - 16) // {step})) AS wc),
win AS (SELECT wr * ((50 - 16) // {step} + 1) + wc AS wid, wr, wc FROM rowsw, colsw),
cover AS (SELECT wid, wr, wc, lab.* FROM win JOIN lab ON "row" >= wr * {step} AND "row" < wr * {step} + 16 AND col >= wc * {step} AND col < wc * {step} + 16),
frac AS (SELECT wid, wr, wc, sum(y) / 256.0::DOUBLE AS frac FROM cover GROUP BY 1, 2, 3)"""


SPLIT = """kept AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || wid), wid) AS rank, count(*) OVER () AS n FROM frac WHERE frac >= 0.2::DOUBLE),
cuts AS (SELECT *, CAST(trunc(0.2::DOUBLE * n) AS BIGINT) AS n_test FROM kept),
parts AS (SELECT wid, wr, wc, rank, n, CASE WHEN rank <= n_test THEN 'test'
 WHEN rank <= n_test + CAST(trunc(0.2::DOUBLE * (n - n_test)) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM cuts)"""
GATHER = """gat AS (SELECT p.wid, c."row" - p.wr * 8 AS r, c.col - p.wc * 8 AS c, c.idx, c.b0, c.y FROM parts p JOIN cover c USING (wid) WHERE p.split = 'train')"""
BATCH = """bat AS (SELECT wid, rank, (rank - 1) // 8 AS batch FROM
 (SELECT wid, row_number() OVER (ORDER BY md5('42:1:' || wid), wid) AS rank FROM parts WHERE split = 'train'))"""
PAIRS = """pairs AS (SELECT d.doc_id, coalesce(l.quality, 255) AS y, CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS pred
 FROM documents d LEFT JOIN labels l USING (doc_id))"""
RANKED = """ev AS (SELECT *, (rank - 1) // 300 AS run, (rank - 1) % 300 + 1 AS epoch FROM
 (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events)),
named AS (SELECT *, CASE WHEN run = 0 THEN event_type ELSE event_type || '#' || (run + 1) END AS experiment FROM ev)"""
EPOCHS = f"""{RANKED},
ep AS (SELECT experiment, epoch, (epoch - 1) // 8 AS batch, value AS val_loss,
 CASE WHEN event_id % 11 = 0 THEN 255 ELSE event_id % 2 END AS y, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS pred FROM named)"""
LABELLED = [OPT, SIZE, TRI, EDGES, BURN, LABEL]
WINDOWED = [*LABELLED, windows()]
PARTED = [*WINDOWED, SPLIT]


def stats(bands: list[str], source: str, extra: str = "") -> str:
    """Thresholds per band from discrete quantiles, mapped to their bin's left edge."""
    edge = lambda q: f"ceil(100 * (CASE WHEN mx > mn THEN mn + least(999999, floor(({q} - mn) / (mx - mn) * 1000000)) * (mx - mn) / 1000000 ELSE mn END)) / 100.0::DOUBLE"
    parts = " UNION ALL ".join(f"SELECT '{b}' AS band, CAST({b} AS DOUBLE) AS x FROM {source} {extra}" for b in bands)
    return f"""val AS ({parts}),
qs AS (SELECT band, min(x) AS mn, max(x) AS mx, quantile_disc(x, 0.001) AS q1, quantile_disc(x, 0.999) AS q2 FROM val GROUP BY band),
thr AS (SELECT band, mn, mx, {edge('q1')} AS lo, {edge('q2')} AS hi FROM qs)"""


def normal() -> str:
    def scaled(b: str) -> str:
        t = f"(SELECT {{}} FROM thr WHERE band = '{b}')"
        lo, hi, mn, mx = (t.format(c) for c in ("lo", "hi", "mn", "mx"))
        cl = lambda v: f"greatest(least({v}, {hi}), {lo})"
        return f"CASE WHEN {cl(mx)} > {cl(mn)} THEN ({cl(b)} - {cl(mn)}) / ({cl(mx)} - {cl(mn)}) ELSE {cl(b)} END AS n_{b}"

    return "nor AS (SELECT idx, \"row\", col, " + ", ".join(scaled(b) for b in BANDS) + " FROM al)"


NORMAL = [OPT, LIDAR, ALIGNED, stats(BANDS, "al"), normal()]


def linear(bands: list[str], weights: list[float], bias: float) -> str:
    return " + ".join([f"{bias}::DOUBLE", *(f"{w}::DOUBLE * {b}" for b, w in zip(bands, weights))])


def softmax2(z0: str, z1: str, k: int) -> str:
    top = f"greatest({z0}, {z1})"
    return f"exp(({z1 if k else z0}) - {top}) / (exp(({z0}) - {top}) + exp(({z1}) - {top}))"


_NAMES = [f"n_{b}" for b in BANDS]
_Z = [linear(_NAMES, WEIGHTS[k], BIAS[k]) for k in (0, 1)]
SCORED = [*NORMAL, f"sc AS (SELECT idx, {softmax2(*_Z, 0)} AS p0, {softmax2(*_Z, 1)} AS p1 FROM nor)"]

COUNTS = """cl AS (SELECT unnest([0, 1]) AS k),
cnt AS (SELECT k, sum(CASE WHEN pred = k AND y = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = k AND y <> k THEN 1 ELSE 0 END) AS fp,
 sum(CASE WHEN pred <> k AND y = k THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN pred <> k AND y <> k THEN 1 ELSE 0 END) AS tn
 FROM cl, pairs WHERE y <> 255 GROUP BY k),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM cnt),
rep AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1, (tp + tn) / (tp + fp + fn + tn) AS acc, tp + fn AS support FROM pr)"""
REPORT = """SELECT CAST(k AS BIGINT) AS k, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
 (SELECT count(*) FROM pairs WHERE y <> 255) AS n_valid, (SELECT count(*) FROM pairs) AS n_total,
 round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(acc, 6) AS accuracy, CAST(support AS BIGINT) AS support FROM rep"""


def votes(kind: str) -> str:
    """Windows over the raster padded by 16 at steps 16, 12 and 8, joined axis by axis."""
    value = {"prob": "p1", "trunc": "floor(p1)"}[kind]
    zero = {"prob": "p0", "trunc": "floor(p0)"}[kind]
    return f"""st AS (SELECT unnest([16, 12, 8]) AS s),
rw AS (SELECT s, wr FROM st, g, LATERAL (SELECT unnest(generate_series(0, (h + 16) // s)) AS wr)),
cw AS (SELECT s, wc FROM st, LATERAL (SELECT unnest(generate_series(0, (50 + 16) // s)) AS wc)),
rm AS (SELECT s, r AS "row", wr FROM rw, (SELECT DISTINCT "row" AS r FROM opt) WHERE r + 16 >= wr * s AND r + 16 < wr * s + 16),
cm AS (SELECT s, c AS col, wc FROM cw, (SELECT DISTINCT col AS c FROM opt) WHERE c + 16 >= wc * s AND c + 16 < wc * s + 16),
vt AS (SELECT s, idx, ((wr * 31 + wc * 17) % 7) / 7::DOUBLE AS p1, 1 - ((wr * 31 + wc * 17) % 7) / 7::DOUBLE AS p0 FROM opt JOIN rm USING ("row") JOIN cm USING (s, col)),
o1 AS (SELECT s, idx, avg({zero}) AS p0, avg({value}) AS p1 FROM vt GROUP BY 1, 2),
mo AS (SELECT idx, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1 FROM o1 GROUP BY 1)"""


def patch_votes(score: str) -> list[str]:
    """The windows of ``votes``; a pixel's vote in a window is the mean of its neighbours inside that window."""
    places = votes("prob").split("vt AS")[0].rstrip().rstrip(",")
    spot = 'v.{0} + 16 + d.{1} >= v.{2} * v.s AND v.{0} + 16 + d.{1} < v.{2} * v.s + 16'
    return [
        places,
        'vt AS (SELECT s, idx, "row" AS r, col AS c, wr, wc FROM opt JOIN rm USING ("row") JOIN cm USING (s, col))',
        "d AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j))",
        f"""nb AS (SELECT v.s, v.idx, v.wr, v.wc, {mirrored("v.r + d.i", "h")} AS "row", {mirrored("v.c + d.j", "50")} AS col
 FROM vt v, d, g WHERE {spot.format("r", "i", "wr")} AND {spot.format("c", "j", "wc")})""",
        'wv AS (SELECT s, nb.idx, wr, wc, avg(b0) / 599999 AS m FROM nb JOIN opt USING ("row", col) GROUP BY ALL)',
        f"o1 AS (SELECT s, idx, avg({score.format('(1 - m)')}) AS p0, avg({score.format('m')}) AS p1 FROM wv GROUP BY 1, 2)",
        "mo AS (SELECT idx, round(avg(p0), 6) AS p0, round(avg(p1), 6) AS p1 FROM o1 GROUP BY 1)",
    ]


def training_loop() -> str:
    """Both classes' weights start at 0 and move by opposite steps, so one vector u = W1 = -W0 says all; the margin is 2 u x."""
    n, bands = len(_NAMES), ", ".join(_NAMES)
    one = ", ".join(f"0.0::DOUBLE AS u{j}" for j in range(n + 1))
    margin = " + ".join([*(f"u{j} * {b}" for j, b in enumerate(_NAMES)), f"u{n}"])
    losses = "w * ln(1 + exp(CASE WHEN y = 1 THEN -m ELSE m END))"
    scored = f"CASE WHEN y = 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS w, 2 * ({margin}) AS m"
    parts = [
        f"""px AS MATERIALIZED (SELECT p.wid, p.split, p.rank, lab.y, {bands} FROM parts p JOIN cover c USING (wid) JOIN lab ON lab.idx = c.idx JOIN nor ON nor.idx = c.idx WHERE p.split <> 'test')""",
        "tw AS (SELECT wid FROM parts WHERE split = 'train')",
        f"vb AS (SELECT wid, (row_number() OVER (ORDER BY md5('42:' || wid), wid) - 1) // {LOOP.batch_size} AS batch FROM parts WHERE split = 'val')",
        f"m0 AS (SELECT {one})",
    ]
    u, rows = 0, []
    for e in range(1, LOOP.max_epochs + 1):
        rate = LOOP.learning_rate * LOOP.gamma ** (e - 1)
        parts.append(f"tb{e} AS (SELECT wid, (row_number() OVER (ORDER BY md5('42:{e}:' || wid), wid) - 1) // {LOOP.batch_size} AS batch, ceil(count(*) OVER () / {LOOP.batch_size}::DOUBLE) AS nb FROM tw)")
        for r in range(LOOP_ROUNDS):
            grads = ", ".join([*(f"sum(w * (1 / (1 + exp(-m)) - y) * {b}) / sum(w) AS g{j}" for j, b in enumerate(_NAMES)), f"sum(w * (1 / (1 + exp(-m)) - y)) / sum(w) AS g{n}"])
            moved = ", ".join(f"u{j} - {rate!r}::DOUBLE * coalesce((SELECT avg(g{j}) FROM b{u + 1}), 0) AS u{j}" for j in range(n + 1))
            parts.append(
                f"b{u + 1} AS MATERIALIZED (SELECT batch, sum({losses}) / sum(w) AS loss, {grads} FROM (SELECT px.*, batch, {scored} FROM px JOIN tb{e} USING (wid), m{u} WHERE floor(batch * {LOOP_ROUNDS} / nb) = {r}) GROUP BY 1)"
            )
            parts.append(f"m{u + 1} AS MATERIALIZED (SELECT {moved} FROM m{u})")
            u += 1
        pooled = " UNION ALL ".join(f"SELECT loss FROM b{k}" for k in range(u - LOOP_ROUNDS + 1, u + 1))
        counts = ", ".join(
            f"sum(CASE WHEN hit = {k} AND y = {k} THEN 1 ELSE 0 END) AS tp{k}, sum(CASE WHEN hit = {k} AND y <> {k} THEN 1 ELSE 0 END) AS fp{k}, sum(CASE WHEN hit <> {k} AND y = {k} THEN 1 ELSE 0 END) AS fn{k}" for k in (0, 1)
        )
        f1 = " + ".join(f"CASE WHEN 2 * tp{k} + fp{k} + fn{k} > 0 THEN 2 * tp{k} / (2 * tp{k} + fp{k} + fn{k}) ELSE 0.0::DOUBLE END" for k in (0, 1))
        parts.append(f"v{e} AS MATERIALIZED (SELECT batch, sum({losses}) / sum(w) AS loss, {counts} FROM (SELECT px.*, batch, {scored}, CASE WHEN {margin} > 0 THEN 1 ELSE 0 END AS hit FROM px JOIN vb USING (wid), m{u}) GROUP BY 1)")
        rows.append(f"SELECT CAST({e} AS BIGINT) AS epoch, {rate!r}::DOUBLE AS lr, (SELECT avg(loss) FROM ({pooled})) AS train_loss, (SELECT avg(loss) FROM v{e}) AS val_loss, (SELECT avg(({f1}) / 2) FROM v{e}) AS val_f1")
    parts.append("logs AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")")
    # the fold: the first epoch after the warm-up is the best so far, later ones have to be better by more than the least step
    first = LOOP_STOP.min_epochs + 1
    best, value = str(first), f"(SELECT val_loss FROM logs WHERE epoch = {first})"
    for e in range(first + 1, LOOP.max_epochs + 1):
        parts.append(f"f{e} AS (SELECT CASE WHEN {value} - val_loss > {LOOP_STOP.min_delta!r}::DOUBLE THEN {e} ELSE {best} END AS best, CASE WHEN {value} - val_loss > {LOOP_STOP.min_delta!r}::DOUBLE THEN val_loss ELSE {value} END AS value FROM logs WHERE epoch = {e})")
        best, value = f"(SELECT best FROM f{e})", f"(SELECT value FROM f{e})"
    chosen = " UNION ALL ".join(f"SELECT {e} AS e, * FROM m{e * LOOP_ROUNDS}" for e in range(1, LOOP.max_epochs + 1))
    weights = ", ".join([*(f"round(u{j}, 6) AS w{j}" for j in range(n)), f"round(u{n}, 6) AS bias"])
    numbers = ", ".join(f"round({c}, 6) AS {c}" for c in ("lr", "train_loss", "val_loss", "val_f1"))
    body = f"SELECT epoch, {numbers}, CAST({best} AS BIGINT) AS best_epoch, {weights} FROM logs, ({chosen}) WHERE e = {best}"
    return sql([*PARTED, *NORMAL[1:], *parts], body)


def mirrored(at: str, n: str) -> str:
    """Source place of a padded place, whatever the padding."""
    m = f"((({at}) % (2 * ({n} - 1)) + 2 * ({n} - 1)) % (2 * ({n} - 1)))"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE 2 * ({n} - 1) - {m} END"


def _focal(reflect: bool, stride: int) -> str:
    parts = " UNION ALL ".join(f"SELECT {i - 1} AS i, {j - 1} AS j, {KERNEL[i][j]}::DOUBLE AS kw" for i in range(3) for j in range(3))
    r, c = '"row" + i', "col + j"
    if reflect:
        r, c = mirrored(r, "h"), mirrored(c, "w")
    width = -(-50 // stride)
    return f"""ker AS ({parts}),
nb AS (SELECT t."row", t.col, kw, {r.replace('"row"', 't."row"').replace("col +", "t.col +")} AS sr, {c.replace("col +", "t.col +")} AS sc FROM opt t, g, ker
 WHERE t."row" % {stride} = 0 AND t.col % {stride} = 0)
SELECT (nb."row" // {stride}) * {width} + nb.col // {stride} AS idx, nb."row" // {stride} AS "row", nb.col // {stride} AS col, round(sum(kw * opt.b0), 3) AS value
FROM nb JOIN opt ON opt."row" = sr AND opt.col = sc GROUP BY ALL"""


STOPPING = f"""RECURSIVE {RANKED},
ep AS (SELECT experiment, epoch, value AS val_loss FROM named),
fold AS (SELECT DISTINCT experiment, CAST(0 AS BIGINT) AS epoch, CAST(NULL AS BIGINT) AS stop, CAST(NULL AS BIGINT) AS best_epoch, CAST(NULL AS DOUBLE) AS best, CAST(0 AS BIGINT) AS misses FROM ep
UNION ALL SELECT f.experiment, e.epoch,
 CASE WHEN e.epoch <= 20 THEN NULL WHEN f.best IS NULL THEN NULL WHEN f.best - e.val_loss > 5e-5 THEN NULL WHEN f.misses + 1 > 15 THEN e.epoch END,
 CASE WHEN e.epoch <= 20 THEN NULL WHEN f.best IS NULL OR f.best - e.val_loss > 5e-5 THEN e.epoch ELSE f.best_epoch END,
 CASE WHEN e.epoch <= 20 THEN NULL WHEN f.best IS NULL OR f.best - e.val_loss > 5e-5 THEN e.val_loss ELSE f.best END,
 CASE WHEN e.epoch <= 20 THEN 0 WHEN f.best IS NULL THEN 1 WHEN f.best - e.val_loss > 5e-5 THEN 0 ELSE f.misses + 1 END
 FROM fold f JOIN ep e ON e.experiment = f.experiment AND e.epoch = f.epoch + 1 WHERE f.stop IS NULL AND e.epoch <= 300)"""

_CE = """SELECT experiment, round(sum(w * loss) / sum(w), 6) AS loss FROM (SELECT experiment, CASE WHEN y = 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS w,
 ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) + greatest(a, b) - CASE WHEN y = 1 THEN b ELSE a END AS loss FROM ({}) WHERE y <> 255) GROUP BY 1"""
_LOGIT = "SELECT experiment, y, 0.0::DOUBLE AS a, (val_loss - 100) / 50 AS b FROM ep"


def sql(parts: list[str], body: str) -> str:
    return f"WITH {', '.join(parts)} {body}"


def oracle_sql() -> dict[str, str]:
    report = sql([PAIRS, COUNTS], REPORT)
    tri_corner = "nth, x / 10 AS x, fmod(y, 80) AS y"
    late_a = [softmax2(linear(["n_b0", "n_b1"], [0.8, -0.6], BIAS[0]), linear(["n_b0", "n_b1"], [-0.7, 0.9], BIAS[1]), k) for k in (0, 1)]
    late_b = [softmax2(linear(["n_l0", "n_l1"], [-0.4, 0.2], BIAS[0]), linear(["n_l0", "n_l1"], [0.6, -0.3], BIAS[1]), k) for k in (0, 1)]
    late = f"lt AS (SELECT idx, {late_a[0]} AS a0, {late_a[1]} AS a1, {late_b[0]} AS b0, {late_b[1]} AS b1 FROM nor)"
    stack = [linear(["a0", "a1", "b0", "b1"], w, b) for w, b in (([1.0, -1.0, 0.5, -0.5], 0.0), ([-1.0, 1.0, -0.5, 0.5], 0.1))]
    turned = """CASE t WHEN 1 THEN 15 - c WHEN 2 THEN 15 - r WHEN 3 THEN c ELSE r END AS r1, CASE t WHEN 1 THEN r WHEN 2 THEN 15 - c WHEN 3 THEN 15 - r ELSE c END AS c1"""
    scored = "SELECT idx, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM sc"
    macro = "avg(p) AS p, avg(r) AS r, avg(f1) AS f1, sum(support) AS s"
    weighted = "sum(p * support) / sum(support) AS p, sum(r * support) / sum(support) AS r, sum(f1 * support) / sum(support) AS f1, sum(support) AS s"
    return {
        "eval_report": report,
        "confusion_matrix": sql(
            [PAIRS],
            """SELECT CAST(k AS BIGINT) AS y, CAST(coalesce(sum(CASE WHEN y = k AND pred = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS pred_0,
 CAST(coalesce(sum(CASE WHEN y = k AND pred = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS pred_1 FROM (SELECT unnest([0, 1]) AS k), pairs WHERE y <> 255 GROUP BY k""",
        ),
        "class_report": sql(
            [PAIRS, COUNTS],
            f"""SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, CAST(s AS BIGINT) AS support FROM (
SELECT CAST(k AS VARCHAR) AS label, p, r, f1, support AS s FROM rep UNION ALL SELECT 'accuracy', min(acc), min(acc), min(acc), sum(support) FROM rep
UNION ALL SELECT 'macro avg', {macro} FROM rep UNION ALL SELECT 'weighted avg', {weighted} FROM rep)""",
        ),
        "report_text": sql(
            [PAIRS, COUNTS],
            """SELECT CAST(0 AS BIGINT) AS line, 'Valid pixels: ' || format('{:,}', (SELECT count(*) FROM pairs WHERE y <> 255)) || ' / ' || format('{:,}', (SELECT count(*) FROM pairs)) AS text
UNION ALL SELECT k + 1, lpad(CASE k WHEN 0 THEN 'background' ELSE 'foreground' END, 12, ' ') || printf(': Acc=%.2f%%  F1=%.2f%%  Prec=%.2f%%  Rec=%.2f%%', round(100 * acc, 2), round(100 * f1, 2), round(100 * p, 2), round(100 * r, 2))
 || '  Samples=' || format('{:,}', CAST(support AS BIGINT)) FROM rep
UNION ALL SELECT 3, 'TN=' || format('{:,}', CAST(tn AS BIGINT)) || '  FP=' || format('{:,}', CAST(fp AS BIGINT)) || '  FN=' || format('{:,}', CAST(fn AS BIGINT)) || '  TP=' || format('{:,}', CAST(tp AS BIGINT)) FROM rep WHERE k = 1""",
        ),
        "report_append": sql([PAIRS, COUNTS], "SELECT e AS experiment, CAST(k AS BIGINT) AS k, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM cnt, (SELECT unnest(['a', 'b']) AS e)"),
        "prepared_scan": sql([OPT, LIDAR, ALIGNED], "SELECT idx, b0, l0 FROM al"),
        "label_scan": sql(LABELLED, "SELECT idx, y FROM lab"),
        "prediction_files": sql(
            [OPT, SIZE, votes("prob").replace("round(avg(p0), 6)", "avg(p0)").replace("round(avg(p1), 6)", "avg(p1)")],
            "SELECT idx, round(CAST(CAST(p0 AS FLOAT) AS DOUBLE), 4) AS p0, round(CAST(CAST(p1 AS FLOAT) AS DOUBLE), 4) AS p1 FROM mo",
        ),
        "georeferenced_files": sql(
            [OPT], 'SELECT idx, 300000 + (col + 0.5::DOUBLE) * 0.25::DOUBLE AS x, 7500000 + ("row" + 0.5::DOUBLE) * -0.25::DOUBLE AS y, b1 AS v1, b3 AS v2 FROM opt'
        ),
        "class_map_files": sql([PAIRS], "SELECT doc_id, CASE y WHEN 0 THEN 10 WHEN 1 THEN 20 END AS dst FROM pairs"),
        "polygon_files": sql(LABELLED[:-1], "SELECT idx FROM hit"),
        "distinct_classes": "SELECT count(DISTINCT quality) AS n_classes FROM labels",
        "valid_pixels": sql([PAIRS], "SELECT count(*) FILTER (WHERE y <> 255) AS n_valid, count(*) AS n_total FROM pairs"),
        "class_remap": sql([PAIRS], "SELECT doc_id, CASE y WHEN 0 THEN 10 WHEN 1 THEN 20 END AS dst FROM pairs"),
        "class_remap_table": sql([PAIRS], "SELECT doc_id, CAST(y AS INTEGER) AS y FROM pairs WHERE y IN (0, 1)"),
        "pixel_grid": sql([OPT], 'SELECT idx, "row", col, "row" * 50 + col AS back FROM opt'),
        "pixel_to_map": sql([OPT], 'SELECT idx, 300000 + (col + 0.5::DOUBLE) * 0.25::DOUBLE AS x, 7500000 + ("row" + 0.5::DOUBLE) * -0.25::DOUBLE AS y FROM opt'),
        "align_sources": sql([OPT, LIDAR, ALIGNED], "SELECT idx, b0, l0, l1 FROM al"),
        "align_stored": sql([OPT, LIDAR, ALIGNED], "SELECT idx, b0, l0, l1 FROM al"),
        "algebra_stored": sql([OPT], "SELECT idx, b0 + b2 AS b0, b1 + b3 AS b1 FROM opt"),
        "prepared_version": sql(
            [*PARTED, LIDAR, ALIGNED, "cov AS (SELECT DISTINCT idx FROM cover JOIN parts USING (wid) WHERE split = 'test')"],
            """SELECT 'optical' AS name, count(*) AS n, CAST(sum(idx) AS BIGINT) AS total FROM opt UNION ALL SELECT 'lidar', count(*), CAST(trunc(sum(l0)) AS BIGINT) FROM al
UNION ALL SELECT 'label', count(*), CAST(sum(y) AS BIGINT) FROM lab UNION ALL SELECT 'test_label', count(*), CAST(sum(CASE WHEN cov.idx IS NULL THEN 255 ELSE y END) AS BIGINT) FROM lab LEFT JOIN cov USING (idx)
UNION ALL SELECT split, count(*), CAST(sum(wid) AS BIGINT) FROM parts WHERE split <> 'test' GROUP BY split""",
        ),
        "merged_statistics": sql(
            [*LABELLED, "val AS (SELECT 'b0' AS band, b0 AS x, y FROM lab UNION ALL SELECT 'b2', b2, y FROM lab)", "cnt AS (SELECT band, greatest(0, least(49, floor(x / 600000 * 50))) AS bin, count(*) AS k FROM val GROUP BY 1, 2)"],
            "SELECT band, count(*) AS n, min(x) AS mn, max(x) AS mx, CAST(sum(y) AS BIGINT) AS positive, (SELECT max(k) FROM cnt WHERE cnt.band = val.band) AS fullest FROM val GROUP BY band",
        ),
        "missing_source": sql([OPT], "SELECT idx, b0, 0.0::DOUBLE AS l0 FROM opt"),
        "raster_bands_long": sql([OPT], "SELECT idx, CAST(1 AS BIGINT) AS band, b0 AS value FROM opt UNION ALL SELECT idx, 2, b2 FROM opt"),
        "nan_to_zero": sql([OPT], "SELECT idx, CASE WHEN idx % 97 = 0 OR idx % 89 = 0 THEN 0.0::DOUBLE ELSE b0 END AS b0 FROM opt"),
        "json_dump": sql([PAIRS], """SELECT doc_id, '{"doc_id":' || doc_id || ',"y":' || y || ',"pred":' || pred || '}' AS json FROM pairs"""),
        "constant_raster": sql([OPT], "SELECT idx, CAST(255 AS BIGINT) AS y FROM opt"),
        "band_histogram": sql(
            [OPT, "mm AS (SELECT min(b0) AS mn, max(b0) AS mx FROM opt)"],
            "SELECT CAST(least(99, floor((b0 - mn) / (mx - mn) * 100)) AS BIGINT) AS bin, count(*) AS n FROM opt, mm GROUP BY 1",
        ),
        "clip_thresholds": sql(
            [OPT, LIDAR, ALIGNED, "al2 AS (SELECT *, 0.123::DOUBLE AS flat FROM al)", stats([*BANDS, "flat"], "al2")], "SELECT band, lo, hi FROM thr"
        ),
        "masked_thresholds": sql([OPT, stats(["b0", "b2"], "opt", "WHERE idx % 3 <> 0")], "SELECT band, lo, hi FROM thr"),
        "clip_normalise": sql(NORMAL, "SELECT idx, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + " FROM nor"),
        "rasterize_polygons": sql(LABELLED[:-1], "SELECT idx FROM hit"),
        "label_stats": sql(LABELLED, "SELECT CAST(sum(y) AS BIGINT) AS n_positive, count(*) AS n_pixels, round(100.0::DOUBLE * sum(y) / count(*), 6) AS percent FROM lab"),
        "reproject_polygons": sql(
            [OPT, SIZE, TRI, EDGES],
            f"""SELECT pid, CAST(nth AS BIGINT) AS nth, round(radians(x) * 6378137.0::DOUBLE, 3) AS x, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0::DOUBLE, 3) + 0.0::DOUBLE AS y
FROM (SELECT pid, {tri_corner} FROM corner)""",
        ),
        "sliding_windows": sql(WINDOWED, "SELECT wid, wr, wc, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idx_sum FROM cover GROUP BY 1, 2, 3"),
        "window_fraction": sql(WINDOWED, "SELECT wid, wr, wc, round(frac, 6) AS frac FROM frac"),
        "window_fraction_odd_step": sql([*LABELLED, windows(6)], "SELECT wid, wr, wc, round(frac, 6) AS frac FROM frac"),
        "keep_windows": sql(WINDOWED, "SELECT wid, wr, wc, round(frac, 6) AS frac FROM frac WHERE frac >= 0.2::DOUBLE"),
        "window_counts": sql(WINDOWED, "SELECT count(*) AS n_before, count(*) FILTER (WHERE frac >= 0.2::DOUBLE) AS n_after FROM frac"),
        "split_windows": sql(PARTED, "SELECT wid, rank, split FROM parts"),
        "split_counts": sql(PARTED, "SELECT split, count(*) AS n FROM parts GROUP BY 1"),
        "separate_split": sql(
            PARTED, "SELECT CASE WHEN rank <= CAST(trunc(0.2::DOUBLE * n) AS BIGINT) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM parts GROUP BY 1"
        ),
        "test_label": sql(
            [*PARTED, "cov AS (SELECT DISTINCT idx FROM cover JOIN parts USING (wid) WHERE split = 'test')"],
            "SELECT lab.idx, CASE WHEN cov.idx IS NULL THEN 255 ELSE y END AS y FROM lab LEFT JOIN cov USING (idx)",
        ),
        "gather_windows": sql([*PARTED, GATHER], "SELECT wid, r, c, idx, b0, y FROM gat"),
        "augment_windows": sql(
            [*PARTED, GATHER, "dig AS (SELECT *, strpos('0123456789abcdef', substr(md5('42:1:' || wid), 1, 1)) - 1 AS d FROM gat)",
             f"tu AS (SELECT *, {turned} FROM (SELECT *, d % 4 AS t, (d // 4) % 2 AS fx, d // 8 AS fy FROM dig))"],
            "SELECT wid, CASE WHEN fy = 1 THEN 15 - r1 ELSE r1 END AS r, CASE WHEN fx = 1 THEN 15 - c1 ELSE c1 END AS c, idx, y FROM tu",
        ),
        "window_batches": sql([*PARTED, BATCH], "SELECT wid, rank, batch FROM bat"),
        "first_batch_sample": sql(
            [*PARTED, *SCORED[1:], "vb AS (SELECT wid, (row_number() OVER (ORDER BY md5('42:' || wid), wid) - 1) // 8 AS batch FROM parts WHERE split = 'val')"],
            "SELECT wid, c.idx, y, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS cls FROM vb JOIN cover c USING (wid) JOIN sc ON sc.idx = c.idx WHERE batch = 0",
        ),
        "first_windows": sql(PARTED, "SELECT wid, rank, split FROM parts WHERE rank <= 20"),
        "window_transform": sql([*PARTED, GATHER], "SELECT wid, 15 - r AS r, c, b0 FROM gat"),
        "mosaic_prob": sql([OPT, SIZE, votes("prob")], "SELECT idx, p0, p1 FROM mo"),
        "mosaic_truncate": sql([OPT, SIZE, votes("trunc")], "SELECT idx, p0, p1 FROM mo"),
        "mosaic_argmax": sql([OPT, SIZE, votes("prob")], "SELECT idx, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS cls FROM mo"),
        "softmax_scores": sql(SCORED, scored),
        "score_windows": sql(SCORED, scored),
        "patch_mosaic": sql([OPT, SIZE, *patch_votes("{}")], "SELECT idx, p0, p1 FROM mo"),
        "patch_mosaic_truncate": sql([OPT, SIZE, *patch_votes("floor(2 * {})")], "SELECT idx, p0, p1 FROM mo"),
        "train_epochs": training_loop(),
        "early_fusion": sql([OPT, LIDAR, ALIGNED], "SELECT idx, b0 AS f0, b1 AS f1, l0 AS f2, l1 AS f3 FROM al"),
        "late_fusion": sql([*NORMAL, late], f"SELECT idx, round({softmax2(*stack, 0)}, 6) AS p0, round({softmax2(*stack, 1)}, 6) AS p1 FROM lt"),
        "segmentation_report": sql(
            [*SCORED, SIZE, TRI, EDGES, BURN, LABEL, "pairs AS (SELECT lab.y, CASE WHEN round(p1, 6) > round(p0, 6) THEN 1 ELSE 0 END AS pred FROM lab JOIN sc USING (idx))", COUNTS],
            REPORT,
        ),
        "early_stop": f"WITH {STOPPING} SELECT experiment, max(stop) AS stop_epoch, arg_max(best_epoch, epoch) AS best_epoch, arg_max(best, epoch) AS best_value FROM fold GROUP BY 1",
        "epoch_loss": sql(
            [EPOCHS],
            """SELECT experiment, batch // 5 AS epoch_group, round(avg(m), 6) AS mean, count(*) AS n_batches
FROM (SELECT experiment, batch, avg(val_loss) AS m FROM ep GROUP BY 1, 2) GROUP BY 1, 2""",
        ),
        "batch_f1": sql(
            [EPOCHS,
             """cnt AS (SELECT experiment, batch, k, sum(CASE WHEN y <> 255 AND pred = k AND y = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y <> 255 AND pred = k AND y <> k THEN 1 ELSE 0 END) AS fp,
 sum(CASE WHEN y <> 255 AND pred <> k AND y = k THEN 1 ELSE 0 END) AS fn FROM ep, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2, 3)""",
             "pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM cnt)",
             "fs AS (SELECT experiment, batch, avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END) AS f1 FROM pr GROUP BY 1, 2)"],
            "SELECT experiment, round(avg(f1), 6) AS f1 FROM fs GROUP BY 1",
        ),
        "running_loss": sql([EPOCHS], "SELECT experiment, epoch, round(avg(val_loss) OVER (PARTITION BY experiment, batch ORDER BY epoch), 6) AS running FROM ep"),
        "lr_schedule": sql([EPOCHS], "SELECT experiment, epoch, round(1e-4::DOUBLE * pow(0.995::DOUBLE, epoch - 1), 12) AS lr FROM ep"),
        "weighted_ce": sql([EPOCHS], _CE.format(_LOGIT)),
        "weighted_ce_probs": sql(
            [EPOCHS, f"lo AS ({_LOGIT})"], _CE.format(f"SELECT experiment, y, {softmax2('a', 'b', 0)} AS a, {softmax2('a', 'b', 1)} AS b FROM lo")
        ),
        "reflect_pad": sql(
            [OPT, SIZE, "pr AS (SELECT unnest(generate_series(0, h + 31)) AS prow, h, w FROM g)", "pc AS (SELECT unnest(generate_series(0, 81)) AS pcol)"],
            f"SELECT prow, pcol, ({mirrored('prow - 16', 'h')}) * 50 + ({mirrored('pcol - 16', '50')}) AS idx FROM pr, pc",
        ),
        "crop_padding": sql([OPT], 'SELECT idx, "row", col, b0 FROM opt'),
        "focal3x3": sql([OPT, SIZE, _focal(True, 1).split("\nSELECT", 1)[0]], "SELECT" + _focal(True, 1).split("\nSELECT", 1)[1]),
        "focal3x3_stride2": sql([OPT, SIZE, _focal(False, 2).split("\nSELECT", 1)[0]], "SELECT" + _focal(False, 2).split("\nSELECT", 1)[1]),
        "upsample2": sql(
            [OPT, "q AS (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j)"],
            'SELECT (2 * "row" + i) * 100 + 2 * col + j AS idx, 2 * "row" + i AS "row", 2 * col + j AS col, b0 FROM opt, q',
        ),
        "band_algebra": sql([OPT], "SELECT idx, b0 + b2 AS b0, b1 + b3 AS b1 FROM opt"),
        "tensor_explode": """SELECT "row", pos // 16 AS band, pos % 16 AS col, round(CAST(value AS DOUBLE), 6) AS value
FROM (SELECT vec_id AS "row", unnest(generate_series(0, len(embedding) - 1)) AS pos, unnest(embedding) AS value FROM embeddings)""",
        "band_select": """SELECT vec_id, CAST(len(embedding[1:4]) AS BIGINT) AS n_first, round(CAST(embedding[4] AS DOUBLE), 6) AS b3,
 round(CAST(embedding[2] AS DOUBLE), 6) AS s0, round(CAST(embedding[4] AS DOUBLE), 6) AS s1 FROM embeddings""",
    }
