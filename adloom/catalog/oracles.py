"""SQL over the same tables that must give the same rows as ``queries``."""

from __future__ import annotations

# ---- building blocks: each is one or more CTEs --------------------------------------

EVENTS = """
ev AS MATERIALIZED (
  SELECT event_id AS instance_id, CAST(1 AS BIGINT) AS shows,
    CAST(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS BIGINT) AS clicks,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS label, user_id, hour(ts) AS h,
    TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
    CAST(floor(value / 10) AS BIGINT) AS v
  FROM events),
slotted AS (
  SELECT instance_id, shows, clicks, label, 1 AS slot, 1000000 + user_id AS sign FROM ev
  UNION ALL SELECT instance_id, shows, clicks, label, 2, 2000000 + h FROM ev
  UNION ALL SELECT instance_id, shows, clicks, label, 3, 3000000 + k FROM ev
  UNION ALL SELECT instance_id, shows, clicks, label, 4, 4000000 + v FROM ev),
tok AS MATERIALIZED (
  SELECT instance_id, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY slot) - 1
    AS INTEGER) AS pos, shows, clicks, label, CAST(sign AS BIGINT) AS sign, slot
  FROM slotted WHERE sign IS NOT NULL)"""

ORDERS = """
li AS (
  SELECT l_orderkey AS instance_id, l_suppkey, CAST(trunc(l_quantity) AS BIGINT) AS q,
    l_returnflag FROM lineitem),
hd AS (
  SELECT instance_id, count(*) AS shows,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS clicks
  FROM li GROUP BY instance_id),
tok AS MATERIALIZED (
  SELECT instance_id, sign, slot, shows, clicks, {label} AS label
  FROM (SELECT instance_id, 1000000 + l_suppkey AS sign, 1 AS slot FROM li
        UNION ALL SELECT instance_id, 2000000 + q, 2 FROM li)
  JOIN hd USING (instance_id) WHERE sign IS NOT NULL)"""
ORDERS_RAW = ORDERS.format(label="CAST(clicks AS INTEGER)")
ORDERS_BINARY = ORDERS.format(label="CASE WHEN clicks > 0 THEN 1 ELSE 0 END")

STAT = """
stat AS MATERIALIZED (
  SELECT sign, CAST(sum(shows) AS BIGINT) AS show_sum, CAST(sum(clicks) AS BIGINT) AS click_sum
  FROM tok GROUP BY sign)"""

KEEP = "keep AS MATERIALIZED (SELECT sign FROM stat WHERE show_sum >= 50)"

TIGHT = "keep AS MATERIALIZED (SELECT sign FROM stat WHERE show_sum >= 420)"

KEPT = "kept AS MATERIALIZED (SELECT * FROM tok WHERE sign IN (SELECT sign FROM keep))"

WEIGHTS = """
wt AS MATERIALIZED (
  SELECT sign, ln((CAST(click_sum AS DOUBLE) + 1)
    / (CAST(show_sum - click_sum AS DOUBLE) + 1)) / 4 AS w FROM stat)"""


def preds(tokens: str = "tok", weights: str = "wt", name: str = "pr") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT instance_id, label, CASE WHEN z >= 30 THEN 1.0 WHEN z <= -30 THEN 0.0
    ELSE 1 / (1 + exp(-z)) END AS p
  FROM (SELECT t.instance_id, max(t.label) AS label, sum(coalesce(x.w, 0)) AS z
        FROM {tokens} t LEFT JOIN {weights} x USING (sign) GROUP BY t.instance_id))"""


def gradient(tokens: str = "tok", predictions: str = "pr", name: str = "gr") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT sign, sum(p - x.label) AS g, count(*) AS touched
  FROM {tokens} t JOIN {predictions} x USING (instance_id) GROUP BY sign)"""


LOSS_TERM = """CASE WHEN label = 1 THEN -ln(greatest(p, 1e-10))
  WHEN label = 0 THEN -ln(greatest(1 - p, 1e-10)) ELSE 0 END"""


def area(predictions: str = "pr", score: str = "round(p, 6)") -> str:
    return f"""
    SELECT sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * CAST(sum(neg) AS DOUBLE), 0) AS auc,
      CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
    FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
          FROM (SELECT {score} AS s, count(*) FILTER (label = 1) AS pos,
                  count(*) FILTER (label = 0) AS neg FROM {predictions} GROUP BY 1))"""


def metrics(predictions: str = "pr") -> str:
    return f"""
  SELECT auc, mae, loss, n, n_pos, n_neg FROM ({area(predictions)}),
    (SELECT avg(abs(label - p)) AS mae, sum({LOSS_TERM}) AS loss, count(*) AS n
     FROM {predictions})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def bucket(buckets: int) -> str:
    mixed = "((instance_id % 1000003 + 1000003) % 1000003) * 48271 % 1000003"
    return f"({mixed}) % {buckets}"


EV = with_(EVENTS)
EV_STAT = (EVENTS, STAT)
EV_PRED = with_(*EV_STAT, WEIGHTS, preds())
TAB = "chr(9)"


def six(column: str) -> str:
    return f"printf('%.6f', {column})"


# ---- vocabulary ----------------------------------------------------------------------

DICTIONARY = """
dict AS MATERIALIZED (
  SELECT sign, arg_min(slot, CAST(instance_id AS HUGEINT) * 2147483648 + pos) AS slot,
    count(*) AS pv FROM {tokens} GROUP BY sign)"""

VOCABULARY = """
top AS (SELECT * FROM dict ORDER BY pv DESC, sign LIMIT 200),
ranked AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY slot ORDER BY pv DESC, sign) - 1 AS INTEGER)
    AS feat_idx FROM top),
slots AS MATERIALIZED (
  SELECT s.slot, CAST(row_number() OVER (ORDER BY pv DESC, sign) - 1 AS INTEGER) AS slot_idx,
    n_feats FROM ranked s JOIN
      (SELECT slot, CAST(count(*) AS INTEGER) AS n_feats FROM ranked GROUP BY slot) USING (slot)
  WHERE feat_idx = 0)"""

ENCODED = (
    EVENTS,
    "train_tok AS (SELECT * FROM tok WHERE instance_id % 10 <> 0)",
    DICTIONARY.format(tokens="train_tok"),
    VOCABULARY,
    """
enc AS MATERIALIZED (
  SELECT t.instance_id, t.label, s.slot_idx, coalesce(r.feat_idx, s.n_feats) AS feat_idx
  FROM tok t JOIN dict d USING (sign) JOIN slots s ON s.slot = d.slot
    LEFT JOIN ranked r ON r.sign = t.sign)""",
)


# ---- gradient descent ------------------------------------------------------------------


def gd_steps(tokens: str, steps: int, mode: str, buckets: int, compat: bool = False) -> list[str]:
    """CTEs w0, w1, ... of weights after each step over the rotating buckets."""
    sign = "-" if compat else "+"
    ctes = ["w0 AS (SELECT CAST(0 AS BIGINT) AS sign, CAST(0 AS DOUBLE) AS w WHERE false)",
            f"all_n AS (SELECT count(DISTINCT instance_id) AS n FROM {tokens})"]
    for i in range(steps):
        part = f"s{i}"
        ctes.append(
            f"{part} AS MATERIALIZED (SELECT * FROM {tokens} WHERE {bucket(buckets)} = {i % buckets})"
        )
        ctes.append(preds(part, f"w{i}", f"p{i}"))
        if mode == "per_instance":
            source = f"(SELECT DISTINCT instance_id, sign FROM {part})"
            n, pull = f"(SELECT n * {1 / buckets} FROM all_n)", "4.0 * touched * w / n"
        else:
            source, n, pull = part, f"(SELECT count(*) FROM p{i})", "4.0 * w"
        ctes.append(gradient(source, f"p{i}", f"g{i}"))
        ctes.append(f"""
w{i + 1} AS MATERIALIZED (
  SELECT sign, w - CASE WHEN touched > 0 THEN 0.5 / n * (g {sign} {pull}) ELSE 0 END AS w
  FROM (SELECT coalesce(a.sign, b.sign) AS sign, coalesce(a.w, 0) AS w, coalesce(b.g, 0) AS g,
          coalesce(b.touched, 0) AS touched, CAST({n} AS DOUBLE) AS n
        FROM w{i} a FULL JOIN g{i} b ON a.sign = b.sign))""")
    return ctes


SPLIT = (
    "tr AS MATERIALIZED (SELECT * FROM kept WHERE instance_id % 10 <> 0)",
    "te AS MATERIALIZED (SELECT * FROM kept WHERE instance_id % 10 = 0)",
)
EV_SPLIT = (*EV_STAT, KEEP, KEPT, *SPLIT)


# ---- convex fits -------------------------------------------------------------------------


def convex_fit(l1: float, l2: float, steps: int = 800) -> str:
    """The minimum by accelerated proximal gradient: a plain method that needs many steps.

    Steps are the inverse of a bound of the curvature (largest row sum of X'X, and the l2
    term), which also fixes the momentum.
    """
    ctes = with_(*EV_SPLIT, f"""
bound AS MATERIALIZED (
  SELECT big, (1 - sqrt({l2} / big)) / (1 + sqrt({l2} / big)) AS momentum
  FROM (SELECT 0.25 * max(r) + {l2} AS big FROM (
    SELECT sign, sum(n) AS r
    FROM tr JOIN (SELECT instance_id, count(*) AS n FROM tr GROUP BY instance_id) USING (instance_id)
    GROUP BY sign))),
fit AS (
  SELECT 0 AS step, sign, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS v FROM keep
  UNION ALL
  SELECT step + 1, sign, n, n + momentum * (n - w)
  FROM (
    SELECT step, sign, w, momentum, sign(u) * greatest(abs(u) - {l1} / big, 0) AS n
    FROM (
      SELECT step, cur.sign, cur.w, big, momentum, v - (coalesce(g, 0) + {l2} * v) / big AS u
      FROM fit cur CROSS JOIN bound LEFT JOIN (
        SELECT tr.sign, sum(1 / (1 + exp(-z)) - label) AS g
        FROM tr JOIN (
          SELECT instance_id, sum(v) AS z FROM tr JOIN fit USING (sign) GROUP BY instance_id) USING (instance_id)
        GROUP BY tr.sign) slope ON slope.sign = cur.sign))
  WHERE step < {steps})""").replace("WITH", "WITH RECURSIVE", 1)
    return ctes + f"SELECT sign, round(w, 4) + 0.0 AS w FROM fit WHERE step = {steps} AND w <> 0"


# ---- factorization machine ---------------------------------------------------------------


def fm_start(signs: str, w: str, name: str = "m0") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT sign, k, {w} AS w,
    ((sign % 1000003) * ((k + 1) * 7919) % 1000003) / CAST(1000003 AS DOUBLE) * 0.2 AS v
  FROM {signs}, (SELECT CAST(unnest(range(4)) AS INTEGER) AS k))"""


def fm_preds(tokens: str, model: str, name: str) -> str:
    """Model rows are (sign, k, w, v); the weight is taken from component 0 only."""
    return f"""
{name}_s AS MATERIALIZED (
  SELECT t.instance_id, k, sum(v) AS s, sum(v * v) AS q, sum(CASE WHEN k = 0 THEN w END) AS lin
  FROM {tokens} t JOIN {model} USING (sign) GROUP BY t.instance_id, k),
{name} AS MATERIALIZED (
  SELECT instance_id, label, CASE WHEN z >= 500 THEN 1.0 WHEN z <= -500 THEN 0.0
    ELSE 1 / (1 + exp(-z)) END AS p
  FROM (SELECT i.instance_id, i.label, coalesce(z, 0) AS z
        FROM (SELECT instance_id, max(label) AS label FROM {tokens} GROUP BY 1) i
        LEFT JOIN (SELECT instance_id, sum(lin) + 0.5 * sum(s * s - q) AS z FROM {name}_s GROUP BY 1)
        USING (instance_id)))"""


def fm_grad(tokens: str, model: str, predictions: str, name: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT sign, m.k, sum(p - x.label) AS g, sum((p - x.label) * (s - v)) AS gv
  FROM {tokens} t JOIN {model} m USING (sign) JOIN {predictions} x USING (instance_id)
    JOIN {predictions}_s y ON y.instance_id = t.instance_id AND y.k = m.k
  GROUP BY sign, m.k)"""


def fm_search(tokens: str, model: str, grad: str, n: str, name: str) -> str:
    """Direct scoring of all 99 candidate models."""
    return f"""
{name}_d AS MATERIALIZED (
  SELECT sign, k, w, v, CASE WHEN g IS NULL THEN 0 ELSE 1.0 / n * (g + 4.0 * w) END AS dw,
    CASE WHEN g IS NULL THEN 0 ELSE 1.0 / n * (gv + 4.0 * v) END AS dv
  FROM {model} LEFT JOIN {grad} USING (sign, k), (SELECT CAST({n} AS DOUBLE) AS n)),
{name}_s AS (
  SELECT t.instance_id, m, k, sum(v - m * dv) AS s, sum((v - m * dv) * (v - m * dv)) AS q,
    sum(CASE WHEN k = 0 THEN w - m * dw END) AS lin
  FROM {tokens} t JOIN {name}_d USING (sign), (SELECT unnest(range(1, 100)) AS m)
  GROUP BY t.instance_id, m, k),
{name}_l AS MATERIALIZED (
  SELECT m, loss, lag(loss) OVER (ORDER BY m) AS prev FROM (
    SELECT m, sum({LOSS_TERM}) AS loss FROM (
      SELECT m, label, CASE WHEN z >= 500 THEN 1.0 WHEN z <= -500 THEN 0.0
        ELSE 1 / (1 + exp(-z)) END AS p
      FROM (SELECT instance_id, m, sum(lin) + 0.5 * sum(s * s - q) AS z
            FROM {name}_s GROUP BY instance_id, m)
      JOIN (SELECT instance_id, max(label) AS label FROM {tokens} GROUP BY 1) USING (instance_id))
    GROUP BY m)),
{name}_best AS MATERIALIZED (
  SELECT coalesce(min(m) FILTER (loss >= prev) - 1, 99) AS best FROM {name}_l)"""


EV_FM = (*EV_STAT, WEIGHTS, fm_start("wt", "w"))


def fm_training(steps: int, buckets: int) -> list[str]:
    ctes = [fm_start("keep", "CAST(0 AS DOUBLE)")]
    for i in range(steps):
        ctes += [
            f"s{i} AS MATERIALIZED (SELECT * FROM tr WHERE {bucket(buckets)} = {i % buckets})",
            fm_preds(f"s{i}", f"m{i}", f"p{i}"),
            fm_grad(f"s{i}", f"m{i}", f"p{i}", f"g{i}"),
            fm_search("tr", f"m{i}", f"g{i}", f"(SELECT count(*) FROM p{i})", f"f{i}"),
            f"""m{i + 1} AS MATERIALIZED (SELECT sign, k, w - best * dw AS w, v - best * dv AS v
  FROM f{i}_d, f{i}_best)""",
        ]
    return ctes


# ---- small fixed net ---------------------------------------------------------------------


def fixed_net_sql() -> str:
    """relu(h W1 + b1) through two linear layers and a sigmoid, spelled out per unit."""
    def w(layer: int, a: str, b: int) -> str:
        return f"((({a}) * 13 + {b} * 7 + {layer}) % 11 - 5) / 10.0"

    sums = ", ".join(
        f"greatest(0.1 + coalesce(sum(h * {w(1, 'slot_idx', j)}), 0), 0) AS r{j}" for j in range(4)
    )
    second = ", ".join(
        "0.1 + " + " + ".join(f"r{a} * {w(2, str(a), j)}" for a in range(4)) + f" AS t{j}"
        for j in range(3)
    )
    z = "0.1 + " + " + ".join(f"t{a} * {w(3, str(a), 0)}" for a in range(3))
    return with_(*ENCODED) + f"""
SELECT instance_id, label, round(1 / (1 + exp(-({z}))), 6) + 0.0 AS p FROM (
  SELECT instance_id, label, {second} FROM (
    SELECT instance_id, max(label) AS label, {sums} FROM (
      SELECT instance_id, slot_idx, max(label) AS label,
        sum(((slot_idx * 31 + feat_idx * 17) % 23 - 11) / 10.0) AS h
      FROM ev LEFT JOIN (SELECT DISTINCT instance_id, slot_idx, feat_idx FROM enc)
        USING (instance_id)
      GROUP BY instance_id, slot_idx)
    GROUP BY instance_id))"""


def net_step_sql() -> str:
    """Gradients of the small net's layers from last to first, then one step of Adam."""
    def w(layer: int, a: str, b: str) -> str:
        return f"((({a}) * 13 + ({b}) * 7 + {layer}) % 11 - 5) / 10.0"

    def total(*terms: str) -> str:
        return " + ".join(terms)

    first = ", ".join(f"0.1137 + coalesce(sum(pool * {w(1, 'slot_idx', str(j))}), 0) AS a{j}" for j in range(4))
    second = ", ".join(
        total("0.1", *[f"greatest(a{i}, 0) * {w(2, str(i), str(j))}" for i in range(4)]) + f" AS t{j}" for j in range(3)
    )
    z = total("0.1", *[f"t{i} * {w(3, str(i), '0')}" for i in range(3)])
    back = ", ".join(
        f"CASE WHEN a{i} > 0 THEN d * ({total(*[f'({w(2, str(i), str(j))}) * ({w(3, str(j), chr(48))})' for j in range(3)])}) ELSE 0 END AS e{i}"
        for i in range(4)
    )
    one = [f"SELECT 'w3', {j}, 0, sum(d * t{j}) FROM b" for j in range(3)] + ["SELECT 'b3', 0, 0, sum(d) FROM b"]
    one += [f"SELECT 'w2', {i}, {j}, sum(greatest(a{i}, 0) * d * {w(3, str(j), '0')}) FROM b" for i in range(4) for j in range(3)]
    one += [f"SELECT 'b2', 0, {j}, sum(d * {w(3, str(j), '0')}) FROM b" for j in range(3)]
    one += [f"SELECT 'b1', 0, {i}, sum(e{i}) FROM b" for i in range(4)]
    one += [f"SELECT 'w1', slot_idx, {i}, coalesce(sum(pool * e{i}), 0) FROM slots LEFT JOIN pooled USING (slot_idx) LEFT JOIN b USING (instance_id) GROUP BY slot_idx" for i in range(4)]
    into = total(*[f"e{i} * {w(1, 'p.slot_idx', str(i))}" for i in range(4)])
    start = " ".join(f"WHEN '{c}' THEN {v}" for c, v in (
        ("w1", w(1, "row", "k")), ("w2", w(2, "row", "k")), ("w3", w(3, "row", "k")), ("emb", "emb0"), ("b1", "0.1137"),
    ))
    return with_(
        *ENCODED,
        "active AS MATERIALIZED (SELECT DISTINCT instance_id, slot_idx, feat_idx FROM enc)",
        "value AS (SELECT slot_idx, unnest(range(n_feats + 1)) AS feat_idx FROM slots)",
        """
position AS MATERIALIZED (
  SELECT slot_idx, feat_idx, ((slot_idx * 31 + feat_idx * 17) % 23 - 11) / 10.0 AS emb0,
    row_number() OVER (ORDER BY slot_idx, feat_idx) - 1 AS row FROM value)""",
        "pooled AS MATERIALIZED (SELECT instance_id, slot_idx, sum(emb0) AS pool FROM active JOIN position USING (slot_idx, feat_idx) GROUP BY instance_id, slot_idx)",
        f"one_layer AS (SELECT instance_id, max(label) AS label, {first} FROM ev LEFT JOIN pooled USING (instance_id) GROUP BY instance_id)",
        f"two_layers AS (SELECT *, {second} FROM one_layer)",
        f"scored AS (SELECT *, {z} AS z FROM two_layers)",
        "slope AS (SELECT *, (1 / (1 + exp(-z)) - label) / (SELECT count(*) FROM ev) AS d FROM scored)",
        f"b AS MATERIALIZED (SELECT *, {back} FROM slope)",
        f"""
gradient(layer, row, k, g) AS (
  {' UNION ALL '.join(one)}
  UNION ALL SELECT 'emb', row, 0, coalesce(sum({into}), 0)
  FROM position p LEFT JOIN active a ON p.slot_idx = a.slot_idx AND p.feat_idx = a.feat_idx
    LEFT JOIN b ON b.instance_id = a.instance_id
  GROUP BY row)""",
    ) + f"""
SELECT layer, CAST(row AS INTEGER) AS row, CAST(k AS INTEGER) AS k, round(
    CASE layer {start} ELSE 0.1 END - 0.001 * sqrt(1 - 0.999) / (1 - 0.9) * 0.1 * g / (sqrt(0.001 * g * g) + 1e-8), 5) + 0.0 AS v
FROM gradient LEFT JOIN (SELECT row AS place, emb0 FROM position) ON layer = 'emb' AND place = row
UNION ALL
SELECT 'loss', 0, 0, round(avg(greatest(z, 0) + ln(1 + exp(-abs(z))) - label * z), 5) + 0.0 FROM scored"""


# ---- oracles -----------------------------------------------------------------------------

FREQ = "fq AS (SELECT sign, count(*) AS freq FROM tok GROUP BY sign)"
INSTANCE_LINE = """
SELECT concat_ws(' ', instance_id, shows, clicks,
  string_agg(sign || ':' || slot, ' ' ORDER BY pos)) AS value
FROM {tokens} GROUP BY instance_id, shows, clicks"""
EMBED = """SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings"""
PENALTY = "SELECT sum(w * w) AS l2_sq, sum(abs(w)) AS l1 FROM wt"

ORACLES = {
    "read_instances": EV + "SELECT instance_id, pos, shows, clicks, CAST(clicks AS INTEGER) AS label, sign, slot FROM tok",
    "read_instances_slot": EV + """
SELECT instance_id, max(label) AS label, CAST(count(*) AS INTEGER) AS n_feats,
  string_agg(CAST(slot AS VARCHAR), ',' ORDER BY pos) AS slots FROM tok GROUP BY instance_id""",
    "read_instances_strict": EV + """
SELECT CASE WHEN instance_id % 7 = 0 THEN instance_id || ':9' ELSE CAST(instance_id AS VARCHAR) END AS line_id,
  shows, clicks, label, CAST(count(*) + (CASE WHEN instance_id % 13 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS n_feats,
  string_agg(CAST(sign AS VARCHAR), ',' ORDER BY pos)
    || CASE WHEN instance_id % 13 = 0 THEN ',18446744073709551615' ELSE '' END AS signs
FROM tok WHERE instance_id % 11 <> 0 AND instance_id % 17 <> 0 GROUP BY instance_id, shows, clicks, label""",
    "read_rejects": EV + """
SELECT instance_id || CASE WHEN instance_id % 7 = 0 THEN ':9' ELSE '' END || ' ' || shows || ' '
  || CASE WHEN instance_id % 11 = 0 THEN 'x' ELSE CAST(clicks AS VARCHAR) END || ' '
  || string_agg(sign || ':' || slot, ' ' ORDER BY pos)
  || CASE WHEN instance_id % 13 = 0 THEN ' 18446744073709551615:4' ELSE '' END
  || CASE WHEN instance_id % 17 = 0 THEN ' a:b' ELSE '' END
  || CASE WHEN instance_id % 5 = 0 THEN ' plain 1:2:3' ELSE '' END AS line
FROM tok WHERE instance_id % 11 = 0 OR instance_id % 17 = 0 GROUP BY instance_id, shows, clicks""",
    "read_feature_list": with_(*EV_STAT, KEEP)
    + "SELECT sign, row_number() OVER (ORDER BY sign) - 1 AS idx FROM keep",
    "read_feature_freq": with_(ORDERS_BINARY, FREQ)
    + "SELECT sign, freq, row_number() OVER (ORDER BY sign) - 1 AS idx FROM fq WHERE freq >= 700",
    "read_feat_stat_text": with_(*EV_STAT) + "SELECT * FROM stat",
    "read_slot_stat": with_(ORDERS_BINARY)
    + "SELECT count(*) AS freq, sign, slot FROM tok GROUP BY sign, slot HAVING count(*) >= 700",
    "read_predictions": EV_PRED + "SELECT label, round(p, 6) + 0.0 AS p FROM pr",
    "feat_stat_roundtrip": with_(*EV_STAT) + "SELECT * FROM stat",
    "feature_list_roundtrip": with_(*EV_STAT, KEEP) + "SELECT CAST(sign AS VARCHAR) AS value FROM keep",
    "instances_text": with_(*EV_STAT, TIGHT, KEPT) + INSTANCE_LINE.format(tokens="kept"),
    "feat_freq_roundtrip": with_(ORDERS_BINARY, FREQ)
    + f"SELECT sign || {TAB} || freq AS value FROM fq",
    "weights_text": with_(*EV_STAT, WEIGHTS)
    + f"SELECT sign || {TAB} || {six('w')} AS value, 3 AS iter FROM wt WHERE w <> 0",
    "gradient_text": with_(*EV_STAT, WEIGHTS, preds(), gradient())
    + f"SELECT sign || {TAB} || {six('g')} AS value FROM gr",
    "predictions_text": EV_PRED + f"SELECT {six('p')} || {TAB} || label AS value FROM pr",
    "fm_weights_text": with_(*EV_FM) + f"""
SELECT sign || {TAB} || {six('max(w)')} || {TAB}
  || string_agg(printf('%.12f', v), {TAB} ORDER BY k) AS value FROM m0 GROUP BY sign""",
    "explode_tokens": EV + "SELECT instance_id, pos, shows, clicks, label, sign, slot FROM tok",
    "token_validity": """
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens,
  CAST(count(*) FILTER (len(string_split(t, ':')) = 2) AS INTEGER) AS n_valid
FROM (SELECT doc_id, CASE i % 3 WHEN 0 THEN t || ':' || i WHEN 1 THEN t || ':1:' || i ELSE t END AS t
      FROM (SELECT doc_id, unnest(words) AS t, unnest(range(len(words))) AS i
            FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents)))
GROUP BY doc_id""",
    "frequent_features": with_(*EV_STAT, KEEP) + "SELECT sign FROM keep",
    "filter_instances": with_(*EV_STAT, TIGHT, KEPT) + """
SELECT instance_id, shows, clicks, label, string_agg(CAST(sign AS VARCHAR), ' ' ORDER BY pos) AS signs
FROM kept GROUP BY instance_id, shows, clicks, label""",
    "binarize_label": with_(ORDERS_RAW)
    + "SELECT DISTINCT instance_id, clicks, CASE WHEN clicks > 0 THEN 1 ELSE 0 END AS label FROM tok",
    "sigmoid_clamped": """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN z >= 30 THEN 1.0 WHEN z <= -30 THEN 0.0 ELSE 1 / (1 + exp(-z)) END, 6) + 0.0 AS p_lr,
  round(CASE WHEN z * 20 >= 500 THEN 1.0 WHEN z * 20 <= -500 THEN 0.0 ELSE 1 / (1 + exp(-z * 20)) END, 6)
    + 0.0 AS p_fm,
  round(0.5 * l_quantity * l_quantity - 2, 6) + 0.0 AS affine, round(abs(z), 6) + 0.0 AS magnitude,
  round(sqrt(l_quantity), 6) + 0.0 AS root, round(-ln(greatest(l_tax, 1e-10)), 6) + 0.0 AS loss
FROM (SELECT *, (l_extendedprice - 50000) / 1000 AS z FROM lineitem)""",
    "sample_instances": EV + f"SELECT instance_id, label FROM ev WHERE {bucket(10)} = 3",
    "split_train_eval": EV + """
SELECT instance_id, CASE WHEN instance_id % 10 = 0 THEN 'eval' ELSE 'train' END AS part FROM ev""",
    "shuffle_instances": EV + "SELECT instance_id, label FROM ev",
    "assign_batches": EV + """
SELECT instance_id, CAST((row_number() OVER (ORDER BY instance_id) - 1) // 256 AS BIGINT) AS batch
FROM ev""",
    "attach_weights": with_(*EV_STAT, KEEP, KEPT, SPLIT[0], """
tr_stat AS (SELECT sign, sum(shows) AS show_sum, sum(clicks) AS click_sum FROM tr GROUP BY sign),
tw AS (SELECT sign, ln((CAST(click_sum AS DOUBLE) + 1)
  / (CAST(show_sum - click_sum AS DOUBLE) + 1)) / 4 AS w FROM tr_stat)""") + """
SELECT instance_id, pos, sign, round(coalesce(w, 0), 6) + 0.0 AS w FROM tok LEFT JOIN tw USING (sign)""",
    "index_gradient": with_(*EV_STAT, KEEP, WEIGHTS, preds(), gradient(),
        "ix AS (SELECT sign, row_number() OVER (ORDER BY sign) - 1 AS idx FROM keep)")
    + "SELECT idx, round(g, 6) + 0.0 AS g FROM gr JOIN ix USING (sign)",
    "merge_weights": with_(*EV_STAT, WEIGHTS) + f"""
SELECT coalesce(a.sign, b.sign) AS sign, round(coalesce(a.w, 0) + coalesce(b.w, 0), 6) + 0.0 AS w
FROM wt a FULL JOIN ({with_(ORDERS_BINARY, STAT, WEIGHTS)} SELECT * FROM wt) b ON a.sign = b.sign""",
    "encode_slots": with_(*ENCODED) + "SELECT instance_id, label, slot_idx, feat_idx FROM enc",
    "feature_stat": with_(ORDERS_BINARY, STAT) + "SELECT * FROM stat",
    "feature_freq": with_(ORDERS_BINARY, FREQ) + "SELECT * FROM fq",
    "distinct_features": with_(*EV_STAT, KEEP) + f"""
SELECT sign FROM keep UNION
SELECT * FROM ({with_(ORDERS_BINARY, STAT, KEEP)} SELECT sign FROM keep)""",
    "count_instances": "SELECT count(*) AS n FROM events",
    "score_linear": EV_PRED + "SELECT instance_id, label, round(p, 6) + 0.0 AS p FROM pr",
    "gradient_linear": with_(ORDERS_RAW, STAT, WEIGHTS, preds(), gradient())
    + "SELECT sign, round(g, 2) + 0.0 AS g FROM gr",
    "sum_vectors": f"""
SELECT label, CAST(k AS INTEGER) AS k, round(sum(CAST(x AS DOUBLE)), 4) + 0.0 AS total
FROM ({EMBED}) GROUP BY label, k""",
    "sampled_count": with_(ORDERS_BINARY)
    + f"SELECT count(DISTINCT instance_id) AS n FROM tok WHERE {bucket(2)} = 1",
    "log_loss": EV_PRED + f"SELECT round(sum({LOSS_TERM}), 6) + 0.0 AS loss FROM pr",
    "mae": with_(ORDERS_RAW, STAT, WEIGHTS, preds())
    + "SELECT round(avg(abs(label - p)), 6) + 0.0 AS mae FROM pr",
    "train_dictionary": with_(EVENTS, """
dtok AS (SELECT instance_id, pos, sign, CASE WHEN instance_id % 3 = 0 THEN slot + 10 ELSE slot END AS slot FROM tok)""",
        DICTIONARY.format(tokens="dtok")) + "SELECT sign, slot, pv FROM dict",
    "pool_embeddings": with_(*ENCODED, """
enc2 AS (SELECT * FROM enc UNION ALL SELECT * FROM enc WHERE instance_id % 2 = 0)""") + """
SELECT instance_id, slot_idx, k, round(coalesce(sum(x), 0), 6) + 0.0 AS value
FROM (SELECT instance_id, slot_idx, k FROM (SELECT instance_id FROM ev),
    (SELECT slot_idx FROM slots), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS k))
LEFT JOIN (
  SELECT instance_id, slot_idx, 0 AS k, ((slot_idx * 31 + feat_idx * 17) % 23 - 11) / 10.0 AS x FROM enc2
  UNION ALL
  SELECT instance_id, slot_idx, 1, ((slot_idx * 7 + feat_idx * 5) % 19 - 9) / 10.0 FROM enc2)
USING (instance_id, slot_idx, k) GROUP BY instance_id, slot_idx, k""",
    "multi_hot": with_(*ENCODED) + """
SELECT instance_id, slot_idx, string_agg(CAST(feat_idx AS VARCHAR), ',' ORDER BY feat_idx) AS active
FROM (SELECT DISTINCT instance_id, slot_idx, feat_idx FROM enc) GROUP BY instance_id, slot_idx""",
    "score_fm": with_(*EV_FM, fm_preds("tok", "m0", "pr"))
    + "SELECT instance_id, label, round(p, 6) + 0.0 AS p FROM pr",
    "weight_norms": with_(*EV_STAT, WEIGHTS)
    + f"SELECT round(l2_sq, 6) + 0.0 AS l2_sq, round(l1, 6) + 0.0 AS l1 FROM ({PENALTY})",
    "objective": EV_PRED + f"""
SELECT form, round(CASE form WHEN 'sum' THEN loss + 2.5 * l2_sq + 3 * l1
  ELSE (loss + 2 * l2_sq) / n END, 6) + 0.0 AS objective
FROM (SELECT sum({LOSS_TERM}) AS loss, count(*) AS n FROM pr), ({PENALTY}),
  (SELECT unnest(['sum', 'mean']) AS form)""",
    "loss_and_gradient": with_(*EV_STAT, KEEP, WEIGHTS, preds(), gradient()) + f"""
SELECT CAST(-1 AS BIGINT) AS sign, CAST(-1 AS BIGINT) AS idx,
  round((loss + 2 * l2_sq) / n, 6) + 0.0 AS value
FROM (SELECT sum({LOSS_TERM}) AS loss, count(*) AS n FROM pr), ({PENALTY})
UNION ALL
SELECT sign, row_number() OVER (ORDER BY sign) - 1,
  round((coalesce(g, 0) + 4 * coalesce(w, 0)) / (SELECT count(*) FROM pr), 6) + 0.0
FROM keep LEFT JOIN gr USING (sign) LEFT JOIN wt USING (sign)""",
    "embedding_moments": f"""
SELECT slot_idx, dim, round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS variance,
  round(m0 * (1 - 0.999) * 0.999 + m1 * (1 - 0.999), 6) + 0.0 AS moving_mean,
  round((0.1 * 0.999 + s0 * (1 - 0.999)) * 0.999 + s1 * (1 - 0.999), 6) + 0.0 AS moving_variance
FROM (SELECT label AS slot_idx, CAST(k AS INTEGER) AS dim, avg(x) AS m, var_pop(x) AS s,
        avg(x) FILTER (vec_id % 2 = 0) AS m0, var_pop(x) FILTER (vec_id % 2 = 0) AS s0,
        avg(x) FILTER (vec_id % 2 = 1) AS m1, var_pop(x) FILTER (vec_id % 2 = 1) AS s1
      FROM (SELECT vec_id, label, CAST(x AS DOUBLE) AS x, k FROM ({EMBED})) GROUP BY label, k)""",
    "pseudo_gradient": with_(*EV_STAT, WEIGHTS,
        "mx AS MATERIALIZED (SELECT sign, CASE WHEN abs(w) < 0.35 THEN 0 ELSE w END AS w FROM wt)",
        preds(weights="mx"), gradient()) + """
SELECT sign, round(CASE WHEN w > 0 THEN g + 4 WHEN w < 0 THEN g - 4 WHEN g < -4 THEN g + 4
  WHEN g > 4 THEN g - 4 ELSE 0 END, 6) + 0.0 AS pg FROM gr JOIN mx USING (sign)""",
    "auc": EV_PRED + f"SELECT round(auc, 6) + 0.0 AS auc, n_pos, n_neg FROM ({area()})",
    "auc_exact": EV + f"""
SELECT round(auc, 6) + 0.0 AS auc, n_pos, n_neg FROM ({area("vp", "p")})""".replace(
        "FROM vp", "FROM (SELECT label, value / 500 AS p FROM ev JOIN events ON event_id = instance_id)"),
    "auc_margins": EV + f"""
SELECT round(auc, 6) + 0.0 AS auc, n_pos, n_neg FROM ({area("vp", "p")})""".replace(
        "FROM vp", "FROM (SELECT label, floor(value) AS p FROM ev JOIN events ON event_id = instance_id)"),
    "dense_index": """
SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx
FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)""",
    "top_features": with_(EVENTS, DICTIONARY.format(tokens="tok"))
    + "SELECT sign, slot, pv FROM dict ORDER BY pv DESC, sign LIMIT 200",
    "build_vocabulary": with_(EVENTS, DICTIONARY.format(tokens="tok"), VOCABULARY)
    + "SELECT sign, slot, pv, slot_idx, feat_idx, n_feats FROM ranked JOIN slots USING (slot)",
    "gd_step_per_instance": with_(ORDERS_BINARY, *gd_steps("tok", 2, "per_instance", 2))
    + "SELECT sign, round(w, 6) + 0.0 AS w FROM w2",
    "gd_step_aggregated": with_(ORDERS_BINARY, *gd_steps("tok", 2, "aggregated", 1))
    + "SELECT sign, round(w, 6) + 0.0 AS w FROM w2",
    "gd_step_compat": with_(ORDERS_BINARY, *gd_steps("tok", 2, "aggregated", 2, compat=True))
    + "SELECT sign, round(w, 6) + 0.0 AS w FROM w2",
    "train_lr_gd": with_(*EV_SPLIT, *gd_steps("tr", 3, "aggregated", 2))
    + "SELECT sign, round(w, 6) + 0.0 AS w FROM w3",
    "train_lr_gd_colocated": with_(*EV_SPLIT, *gd_steps("tr", 3, "aggregated", 2))
    + "SELECT sign, round(w, 6) + 0.0 AS w FROM w3",
    "train_history": with_(
        *EV_SPLIT, *gd_steps("tr", 3, "aggregated", 2),
        *[preds("te", f"w{i + 1}", f"e{i}") for i in range(3)],
        *[f"h{i} AS MATERIALIZED ({metrics(f'e{i}')})" for i in range(3)],
    ) + "\nUNION ALL\n".join(f"""
SELECT {i} AS iter, (SELECT count(*) FROM p{i}) AS n_sampled,
  (SELECT count(*) FROM w{i + 1} WHERE w <> 0) AS n_saved, round(auc, 6) + 0.0 AS auc,
  round(mae, 6) + 0.0 AS mae, round(loss, 6) + 0.0 AS loss FROM h{i}""" for i in range(3)),
    "train_lr_l2": convex_fit(0.0, 4.0),
    "train_lr_elastic": convex_fit(3.0, 5.0),
    "fm_gradient": with_(*EV_FM, KEEP,
        "mm AS MATERIALIZED (SELECT * FROM m0 WHERE sign IN (SELECT sign FROM keep))",
        fm_preds("tok", "mm", "pr"), fm_grad("tok", "mm", "pr", "gr"))
    + "SELECT sign, k, round(g, 5) + 0.0 AS g, round(gv, 5) + 0.0 AS gv FROM gr",
    "fm_step_search": with_(*EV_FM, fm_preds("tok", "m0", "pr"), fm_grad("tok", "m0", "pr", "gr"),
        fm_search("tok", "m0", "gr", "(SELECT count(*) FROM pr)", "f")) + """
SELECT CAST(m AS INTEGER) AS multiplier, round(loss, 4) + 0.0 AS loss,
  CASE WHEN m = best THEN 1 ELSE 0 END AS accepted,
  (SELECT round(sum(w - best * dw) FILTER (k = 0), 4) + 0.0 FROM f_d, f_best) AS w_sum,
  (SELECT round(sum(v - best * dv), 4) + 0.0 FROM f_d, f_best) AS v_sum
FROM f_l, f_best WHERE m <= least(best + 1, 99)""",
    "train_fm": with_(*EV_SPLIT, *fm_training(2, 2))
    + "SELECT sign, k, round(w, 5) + 0.0 AS w, round(v, 5) + 0.0 AS v FROM m2",
    "train_dnn_step": net_step_sql(),
    "train_dnn_sharded_step": net_step_sql(),
    "score_dnn": fixed_net_sql(),
    "score_dnn_sharded": fixed_net_sql(),
    "evaluate": with_(*EV_SPLIT, *gd_steps("tr", 2, "aggregated", 1), preds("te", "w2", "pe")) + f"""
SELECT round(auc, 6) + 0.0 AS auc, round(mae, 6) + 0.0 AS mae, round(loss, 6) + 0.0 AS loss, n, n_pos,
  n_neg FROM ({metrics('pe')})""",
}
