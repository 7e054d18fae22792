"""The engine's queries in DuckDB's SQL, written independently of the plans."""

from __future__ import annotations

_LOG = """
ev AS (
  SELECT user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS path, user_id::VARCHAR AS target, ts, event_id,
         CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS bucket,
         value AS amount FROM events
), lg AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS seq FROM ev
), st AS (
  SELECT path, target, seq, bucket, amount, coalesce(sum(amount) OVER b, 0e0) AS pot,
         last_value(CASE WHEN bucket >= 2 THEN amount END IGNORE NULLS) OVER b AS last_bet,
         coalesce(sum(CASE WHEN bucket >= 2 THEN 1 ELSE 0 END) OVER b, 0)::BIGINT AS raises
  FROM lg WINDOW b AS (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pt AS (
  SELECT *, CASE (seq - 1) % 7 WHEN 0 THEN 'sb' WHEN 1 THEN 'bb' WHEN 2 THEN 'utg' WHEN 3 THEN 'hj' WHEN 4 THEN 'co' WHEN 5 THEN 'btn' ELSE 'unknown' END AS position,
         CASE seq % 4 WHEN 0 THEN 'heads_up' WHEN 1 THEN 'three_way' ELSE 'multiway' END AS active,
         CASE WHEN raises > 0 THEN 'facing_bet' ELSE 'no_bet' END AS facing,
         CASE raises WHEN 0 THEN 'raises_0' WHEN 1 THEN 'raises_1' ELSE 'raises_2plus' END AS raise_label,
         CASE WHEN pot <= 0 OR 1500 > 10 * pot THEN 'deep' WHEN 1500 > 3 * pot THEN 'medium' ELSE 'shallow' END AS spr
  FROM st
), ks AS (
  SELECT *, position || '|' || active || '|' || facing || '|' || raise_label || '|' || spr AS state_key FROM pt
)"""

_CLASSES = """
rk AS (SELECT i, substr('AKQJT98765432', i, 1) AS r, 15 - i AS v FROM range(1, 14) t(i)
), cls AS (
  SELECT (row_number() OVER (ORDER BY a.i, b.i, s) - 1)::INTEGER AS class_id, a.r || b.r || CASE s WHEN 0 THEN '' WHEN 1 THEN 's' ELSE 'o' END AS hand_class,
         a.v AS high, b.v AS low, s = 0 AS pair, s = 1 AS suited
  FROM rk a, rk b, range(0, 3) q(s) WHERE (a.i = b.i AND s = 0) OR (a.i < b.i AND s > 0)
), ft AS (
  SELECT *, greatest(0, high - low - 1) AS gap, (CASE WHEN high >= 10 THEN 1 ELSE 0 END + CASE WHEN low >= 10 THEN 1 ELSE 0 END) AS broadways, (high = 14 OR low = 14) AS has_ace FROM cls
), hc AS (
  SELECT *, greatest(0.01e0, least(0.99e0, CASE WHEN pair THEN 0.52e0 + 0.45e0 * ((high - 2) / 12e0) ELSE
      0.10e0 + 0.45e0 * ((high - 2) / 12e0) + 0.25e0 * ((low - 2) / 12e0) + CASE WHEN suited THEN 0.08e0 ELSE 0e0 END
      + CASE WHEN gap <= 1 THEN 0.07e0 WHEN gap = 2 THEN 0.03e0 ELSE 0e0 END + 0.04e0 * broadways
      + CASE WHEN has_ace THEN 0.05e0 ELSE 0e0 END - 0.025e0 * greatest(0, gap - 2) END)) AS strength FROM ft
), su AS (SELECT i, substr('SHDC', i, 1) AS s FROM range(1, 5) t(i)
), cb AS (
  SELECT class_id, hand_class, substr(hand_class, 1, 1) || x.s AS c1, substr(hand_class, 2, 1) || y.s AS c2 FROM cls, su x, su y
  WHERE (pair AND x.i < y.i) OR (suited AND x.i = y.i) OR (NOT pair AND NOT suited AND x.i <> y.i)
)"""


def _table(phi: float) -> str:
    return f"""
kd AS (SELECT DISTINCT state_key, position, active, facing, raise_label, spr FROM ks
), sc AS (
  SELECT state_key, class_id, hand_class, facing = 'facing_bet' AS f, strength AS s,
         greatest(0e0, least(1e0, strength
           + CASE position WHEN 'sb' THEN -0.02e0 WHEN 'bb' THEN 0.01e0 WHEN 'utg' THEN -0.08e0 WHEN 'hj' THEN -0.02e0 WHEN 'co' THEN 0.05e0 WHEN 'btn' THEN 0.08e0 ELSE 0e0 END
           + CASE active WHEN 'heads_up' THEN 0.04e0 WHEN 'three_way' THEN -0.02e0 ELSE -0.06e0 END
           + CASE raise_label WHEN 'raises_0' THEN 0e0 WHEN 'raises_1' THEN -0.12e0 ELSE -0.24e0 END)) AS x,
         CASE spr WHEN 'deep' THEN 0e0 WHEN 'medium' THEN 0.04e0 ELSE 0.10e0 END AS g,
         CASE WHEN (pair AND high >= 10) OR (high = 14 AND low >= 11) THEN 1 ELSE 0 END AS prem,
         CASE WHEN suited AND gap <= 2 AND low >= 5 THEN 1 ELSE 0 END AS spec
  FROM kd, hc
), s5 AS (
  SELECT state_key, class_id, hand_class,
    CASE WHEN f THEN 1.5e0 - 3e0 * x ELSE 1.1e0 - 2.4e0 * x END + {phi}e0 * (-2e0 * (s - 0.5e0)) AS v0,
    CASE WHEN f THEN 0.2e0 + 1.4e0 * x + 0.15e0 * spec ELSE 0.25e0 + 0.9e0 * x + 0.25e0 * spec END + {phi}e0 * (1.5e0 * (0.5e0 - s)) AS v1,
    CASE WHEN f THEN -0.8e0 + (1.1e0 + g) * x + 0.25e0 * prem ELSE -0.35e0 + (1e0 + g) * x END + {phi}e0 * (0.8e0 * (0.6e0 - s)) AS v2,
    CASE WHEN f THEN -1e0 + (1.4e0 + g) * x + 0.5e0 * prem ELSE -0.55e0 + (1.2e0 + g) * x + 0.25e0 * prem END + {phi}e0 * (1.2e0 * (0.6e0 - s)) AS v3,
    CASE WHEN f THEN -1.6e0 + (1.2e0 + g) * x + 0.75e0 * prem ELSE -1.6e0 + (0.8e0 + g) * x + 0.55e0 * prem END + {phi}e0 * (1.8e0 * (0.6e0 - s)) AS v4
  FROM sc
), un AS (
  SELECT state_key, class_id, hand_class, bucket, [v0, v1, v2, v3, v4][bucket + 1] AS v FROM s5, range(0, 5) t(bucket)
), ex AS (
  SELECT *, exp(v - max(v) OVER w) AS e FROM un WINDOW w AS (PARTITION BY state_key, class_id)
), fl AS (
  SELECT *, 0.95e0 * (e / sum(e) OVER w) + 0.01e0 AS q FROM ex WINDOW w AS (PARTITION BY state_key, class_id)
), lk AS (
  SELECT state_key, class_id, hand_class, bucket::INTEGER AS bucket, q / sum(q) OVER w AS lik FROM fl WINDOW w AS (PARTITION BY state_key, class_id)
)"""


def _post(dead: str) -> str:
    return f"""
pr AS (
  SELECT class_id, hand_class, count(*) FILTER (WHERE c1 NOT IN ({dead}) AND c2 NOT IN ({dead})) AS n FROM cb GROUP BY class_id, hand_class
), pp AS (SELECT class_id, hand_class, n / sum(n) OVER () AS prior FROM pr
)"""


_RANGE = """
ll AS (
  SELECT path, class_id, sum(ln(lik)) AS l, count(*) AS n FROM ks JOIN lk USING (state_key, bucket) GROUP BY path, class_id
), wt AS (
  SELECT path, class_id, hand_class, n, prior * exp(l - max(l) OVER w) AS u, max(l) OVER w AS top FROM ll JOIN pp USING (class_id) WINDOW w AS (PARTITION BY path)
), po AS (
  SELECT *, u / sum(u) OVER w AS p, ln(sum(u) OVER w) + top AS log_likelihood FROM wt WINDOW w AS (PARTITION BY path)
)"""

def _drawn(source: str, key: str, n: int, keep: str = "") -> str:
    """CTEs u0..u<n>: different card numbers drawn from ``key``."""
    keep = keep and f", {keep}"
    out = [f"u0 AS (SELECT {key} AS k, {key} AS x, []::INTEGER[] AS t{keep} FROM {source})"]
    for i in range(n):
        x = "(x * 1103515245 + 12345) % 2147483648"
        place = f"((({x}) // 65536) % {52 - i})::INTEGER"
        card = f"list_reduce(list_prepend({place}, list_sort(t)), lambda p, y: CASE WHEN y <= p THEN p + 1 ELSE p END)"
        out.append(f"u{i + 1} AS (SELECT k, {x} AS x, list_append(t, {card}) AS t{keep} FROM u{i})")
    return ", ".join(out)


_DEALS = (
    _drawn("orders", "o_orderkey", 7)
    + """, dl AS (
  SELECT k AS o_orderkey, list_transform(t, lambda c: substr('AKQJT98765432', 13 - c % 13, 1) || substr('SHDC', c // 13 + 1, 1)) AS cards,
         list_transform(t, lambda c: c % 13 + 2) AS vals, list_transform(t, lambda c: c // 13) AS suits FROM u7
)"""
)

_HANDS = (
    """
hd AS (SELECT path, any_value(target)::BIGINT AS uid, min(event_id) AS key, count(*) AS m FROM lg GROUP BY path
), hh AS (SELECT *, uid % 5 + 2 AS n, CASE WHEN uid % 7 = 0 THEN 400 ELSE 10000 END AS stack FROM hd
), ac AS (
  SELECT path, n, stack, seq, n + seq - 1 + (seq - 1) // 2 AS pos, (seq - 1) // 2 AS street,
         CASE WHEN event_id % 991 = 0 THEN 9 ELSE (CASE WHEN seq > 2 OR n = 2 THEN 0 ELSE 2 END + (seq - 1) % 2) % n + 1 END AS seat,
         CASE WHEN event_id % 997 = 1 THEN 'xx' WHEN bucket = 0 THEN 'f' WHEN bucket <= 2 THEN 'cc' ELSE 'cbr' END AS verb,
         CASE WHEN event_id % 997 <> 1 AND bucket >= 3 THEN CASE WHEN event_id % 97 = 2 THEN 5 ELSE 100 * (seq + 1) + floor(amount)::BIGINT % 100 END END AS raise_to
  FROM lg JOIN hh USING (path)
  UNION ALL SELECT path, n, stack, m + 1, n + m + (m - 1) // 2, (m - 1) // 2, 1, 'sm', NULL FROM hh WHERE m >= 5
), r1 AS (
  SELECT *, seat <= n AS known, sum(CASE WHEN verb <> 'sm' THEN 1 ELSE 0 END) OVER (PARTITION BY path, street ORDER BY pos) - 1 AS action_index,
         coalesce(last_value(raise_to IGNORE NULLS) OVER (PARTITION BY path, street ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE street WHEN 0 THEN 100 ELSE 0 END) AS cur_bet,
         CASE seat WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 0 END AS blind
  FROM ac
), r2 AS (SELECT *, CASE verb WHEN 'cc' THEN cur_bet WHEN 'cbr' THEN raise_to ELSE 0 END AS amount FROM r1
), r3 AS (
  SELECT *, coalesce(last_value(CASE WHEN verb NOT IN ('f', 'sm') THEN amount END IGNORE NULLS) OVER (PARTITION BY path, street, seat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     CASE street WHEN 0 THEN blind ELSE 0 END) AS in_before FROM r2
), r4 AS (SELECT *, CASE WHEN verb IN ('f', 'sm') THEN 0 ELSE amount - in_before END AS contrib, CASE WHEN verb = 'f' AND known THEN 1 ELSE 0 END AS fold FROM r3
), r5 AS (
  SELECT *, 150 + coalesce(sum(contrib) OVER h, 0) AS pot_before, CASE WHEN known THEN stack - blind - coalesce(sum(contrib) OVER hs, 0) END AS stack_before,
         coalesce(sum(CASE WHEN verb = 'cbr' THEN 1 ELSE 0 END) OVER st, 0) AS level_before, n - coalesce(sum(fold) OVER h, 0) AS live, coalesce(max(fold) OVER hs, 0) AS folded
  FROM r4 WINDOW h AS (PARTITION BY path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    hs AS (PARTITION BY path, seat ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), st AS (PARTITION BY path, street ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), r6 AS (
  SELECT *, CASE WHEN street > 3 THEN 'too many board deals' WHEN NOT known THEN 'unknown seat' WHEN folded = 1 THEN 'acted after folding' WHEN verb = 'sm' THEN NULL
      WHEN verb = 'xx' THEN 'unknown action' WHEN verb = 'cc' AND contrib < 0 THEN 'negative call contribution' WHEN verb = 'cbr' AND NOT contrib > 0 THEN 'non-positive raise'
      WHEN contrib > stack_before THEN 'negative stack' END AS violation,
    ['sb', 'bb', 'utg', 'hj', 'co', 'btn', 'unknown', 'unknown', 'unknown'][seat] AS position, CASE live WHEN 2 THEN 'heads_up' WHEN 3 THEN 'three_way' ELSE 'multiway' END AS active,
    CASE WHEN level_before > 0 OR seat <> 2 THEN 'facing_bet' ELSE 'no_bet' END AS facing, CASE level_before WHEN 0 THEN 'raises_0' WHEN 1 THEN 'raises_1' ELSE 'raises_2plus' END AS raise_label,
    CASE WHEN pot_before <= 0 OR coalesce(stack_before, 0) > 10 * pot_before THEN 'deep' WHEN coalesce(stack_before, 0) > 3 * pot_before THEN 'medium' ELSE 'shallow' END AS spr,
    coalesce(['ann', 'bob', 'cyd', 'dan', 'eve', 'fay'][CASE WHEN known THEN seat END], 'p' || seat) AS player, pot_before + contrib AS pot_after
  FROM r5
), rp AS (
  SELECT *, position || '|' || active || '|' || facing || '|' || raise_label || '|' || spr AS state_key, level_before + CASE WHEN verb = 'cbr' THEN 1 ELSE 0 END AS level_after,
         CASE WHEN violation IS NULL THEN CASE verb WHEN 'f' THEN 0 WHEN 'cc' THEN 1 ELSE CASE WHEN amount < 0.5 * pot_after THEN 2 WHEN amount < pot_after THEN 3 ELSE 4 END END END AS bucket
  FROM r6 WHERE verb <> 'sm' OR violation IS NOT NULL
), sp AS (SELECT * FROM hh WHERE path NOT IN (SELECT path FROM rp WHERE violation IS NOT NULL)
), sr AS (SELECT rp.* FROM rp JOIN sp USING (path)
)"""
)

_CARDS = (
    _drawn("hh", "key", 20, "path, n, m")
    + """, cd AS (SELECT path, n, m, list_transform(t, lambda c: substr('AKQJT98765432', 13 - c % 13, 1) || substr('SHDC', c // 13 + 1, 1)) AS c FROM u20
), ho AS (SELECT path, i AS seat, ['ann', 'bob', 'cyd', 'dan', 'eve', 'fay'][i] AS player, c[2 * i - 1] AS c1, c[2 * i] AS c2 FROM cd, range(1, 7) t(i) WHERE i <= n
), bo AS (SELECT path, n + 3 * k - 1 AS pos, k AS street, array_to_string(c[13:14 + k], '') AS board FROM cd, range(1, 5) t(k) WHERE k <= (m - 1) // 2
)"""
)

_PAIRS = """
ks AS (SELECT path, player AS target, bucket, state_key, position, active, facing, raise_label, spr FROM sr WHERE street = 0
), pa AS (SELECT o.path, o.player AS observer, t.player AS target, o.c1 AS d1, o.c2 AS d2 FROM ho o JOIN ho t ON o.path = t.path AND o.seat <> t.seat JOIN sp ON sp.path = o.path
), dd AS (SELECT DISTINCT d1, d2 FROM pa
), pn AS (SELECT d1, d2, class_id, hand_class, count(*) FILTER (WHERE c1 NOT IN (d1, d2) AND c2 NOT IN (d1, d2)) / 1225e0 AS prior FROM dd, cb GROUP BY ALL
)"""

_PAIR_RANGE = """
ll AS (SELECT path, target, class_id, sum(ln(lik)) AS l, count(*) AS n FROM ks JOIN lk USING (state_key, bucket) GROUP BY path, target, class_id
), wt AS (
  SELECT path, observer, target, d1, d2, class_id, hand_class, n, prior * exp(l - max(l) OVER w) AS u, max(l) OVER w AS top
  FROM pa JOIN ll USING (path, target) JOIN pn USING (d1, d2, class_id) WINDOW w AS (PARTITION BY path, observer, target)
), po AS (SELECT *, u / sum(u) OVER w AS p, ln(sum(u) OVER w) + top AS log_likelihood FROM wt WINDOW w AS (PARTITION BY path, observer, target)
)"""


def _pair(phi: float) -> str:
    return f"WITH {_LOG[: _LOG.index('), st AS')]}), {_HANDS}, {_CLASSES}, {_CARDS}, {_PAIRS}, {_table(phi)}, {_PAIR_RANGE}"


_SCORE = """
ms AS (SELECT m FROM range(0, 128) t(m) WHERE bit_count(m::INTEGER) = 5
), fv AS (
  SELECT o_orderkey, m, vals[i] AS v, suits[i] AS s FROM dl, ms, range(1, 8) t(i) WHERE (m >> (i - 1)) & 1 = 1
), cn AS (
  SELECT *, count(*) OVER (PARTITION BY o_orderkey, m, v) AS c FROM fv
), gr AS (
  SELECT o_orderkey, m, list(c ORDER BY c DESC, v DESC) AS form, list(v ORDER BY c DESC, v DESC) AS vs, count(DISTINCT s) = 1 AS fl, max(v) AS hi, min(v) AS lo, count(DISTINCT v) AS dv FROM cn GROUP BY o_orderkey, m
), sx AS (
  SELECT *, CASE WHEN vs = [14, 5, 4, 3, 2] THEN 5 WHEN dv = 5 AND hi - lo = 4 THEN hi ELSE 0 END AS run FROM gr
), rt AS (
  SELECT o_orderkey,
    CASE WHEN fl AND run > 0 THEN 8 WHEN form = [4, 4, 4, 4, 1] THEN 7 WHEN form = [3, 3, 3, 2, 2] THEN 6 WHEN fl THEN 5 WHEN run > 0 THEN 4
         WHEN form = [3, 3, 3, 1, 1] THEN 3 WHEN form = [2, 2, 2, 2, 1] THEN 2 WHEN form = [2, 2, 1, 1, 1] THEN 1 ELSE 0 END AS category,
    CASE WHEN run > 0 THEN [run] WHEN form[1] = 4 THEN [vs[1], vs[5]] WHEN form = [3, 3, 3, 2, 2] THEN [vs[1], vs[4]] WHEN form[1] = 3 THEN [vs[1], vs[4], vs[5]]
         WHEN form = [2, 2, 2, 2, 1] THEN [vs[1], vs[3], vs[5]] WHEN form[1] = 2 THEN [vs[1], vs[3], vs[4], vs[5]] ELSE vs END AS kickers
  FROM sx
), bs AS (
  SELECT o_orderkey, category, kickers FROM rt QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY category DESC, kickers DESC) = 1
)"""

_PSI_SCORES = "[[-3e0, 0.5e0, 1.2e0, 1.8e0, 1.5e0], [-2e0, 1e0, 1.5e0, 1.2e0, 0.5e0], [-0.5e0, 1.5e0, 0.8e0, 0.3e0, -0.5e0], [0.5e0, 1e0, 0.2e0, -0.5e0, -1.5e0], [-1e0, 0.8e0, 1e0, 1.2e0, 0.8e0], [0.5e0, 1e0, 0.3e0, -0.5e0, -1e0], [1.5e0, 0.2e0, -0.3e0, -0.8e0, -1.5e0]]"
_NAMES = "['nuts/near-nuts', 'strong made', 'medium made', 'weak made', 'strong draw', 'weak draw', 'air']"
_PSI = f"""
p0 AS (SELECT i::INTEGER AS bucket_idx, {_NAMES}[i + 1] AS strength, a::INTEGER AS bucket, exp({_PSI_SCORES}[i + 1][a + 1]) AS e FROM range(0, 7) x(i), range(0, 5) y(a)
), p1 AS (SELECT *, 0.9e0 * e / sum(e) OVER (PARTITION BY bucket_idx) + 0.02e0 AS q FROM p0
), ps AS (SELECT bucket_idx, strength, bucket, q / sum(q) OVER (PARTITION BY bucket_idx) AS psi FROM p1
)"""


#: Strengths of the 169 classes on each flop of ``fb`` (board, b).
_RATED = """kco AS (
              SELECT board, b, class_id, c1, c2, row_number() OVER (PARTITION BY board, class_id ORDER BY x.i, y.i) AS k
              FROM fb, cb JOIN su x ON x.s = substr(c1, 2, 1) JOIN su y ON y.s = substr(c2, 2, 1) WHERE NOT list_contains(b, c1) AND NOT list_contains(b, c2)
            ), kun AS (
              SELECT board, class_id, b, c1, c2, 15 - instr('AKQJT98765432', substr(c, 1, 1)) AS v, substr(c, 2, 1) AS s
              FROM (SELECT *, unnest(list_concat([c1, c2], b)) AS c FROM kco WHERE k = 1)
            ), kcn AS (SELECT *, count(*) OVER (PARTITION BY board, class_id, v) AS n, count(*) OVER (PARTITION BY board, class_id, s) AS ns FROM kun
            ), kg AS (
              SELECT board, class_id, any_value(b) AS b, any_value(c1) AS c1, any_value(c2) AS c2, list(n ORDER BY n DESC, v DESC) AS form, list(v ORDER BY n DESC, v DESC) AS vs,
                     max(ns) AS ms, max(v) AS hi, min(v) AS lo, list_distinct(list(v)) AS dv FROM kcn GROUP BY board, class_id
            ), kh AS (
              SELECT *, 15 - instr('AKQJT98765432', substr(c1, 1, 1)) AS h1, 15 - instr('AKQJT98765432', substr(c2, 1, 1)) AS h2,
                     list_transform(b, lambda c: 15 - instr('AKQJT98765432', substr(c, 1, 1))) AS bv, len(list_distinct(list_transform(b, lambda c: substr(c, 2, 1)))) = 1 AS mono,
                     CASE WHEN vs = [14, 5, 4, 3, 2] THEN 5 WHEN len(dv) = 5 AND hi - lo = 4 THEN hi ELSE 0 END AS run,
                     CASE WHEN hi = 14 THEN list_append(dv, 1) ELSE dv END AS low FROM kg
            ), ko AS (
              SELECT *, list_max(bv) AS top, len(list_distinct(bv)) < 3 AS paired,
                     list_filter(range(1, 11), lambda t: len(list_filter(low, lambda y: y >= t AND y <= t + 4)) = 4) AS win FROM kh
            ), kz AS (
              SELECT *, CASE WHEN ms = 4 THEN 9 ELSE 0 END
                + CASE WHEN len(list_filter(win, lambda t: NOT list_contains(low, t) OR NOT list_contains(low, t + 4))) > 0 THEN 8 WHEN len(win) > 0 THEN 4 ELSE 0 END
                + CASE (CASE WHEN h1 > top THEN 1 ELSE 0 END) + (CASE WHEN h2 > top THEN 1 ELSE 0 END) WHEN 2 THEN 6 WHEN 1 THEN 3 ELSE 0 END AS outs FROM ko
            ), kr AS (
              SELECT board, class_id, CASE WHEN (ms = 5 AND run > 0) OR form[1] = 4 OR form = [3, 3, 3, 2, 2] THEN 0
                WHEN ms = 5 THEN CASE WHEN h1 = 14 OR h2 = 14 OR NOT mono THEN 0 ELSE 1 END
                WHEN run > 0 THEN CASE WHEN paired OR mono THEN 1 ELSE 0 END
                WHEN form[1] = 3 THEN CASE WHEN h1 = h2 AND list_contains(bv, h1) AND NOT mono THEN 0 ELSE 1 END
                WHEN form = [2, 2, 2, 2, 1] THEN 1
                WHEN form[1] = 2 THEN CASE WHEN vs[1] > top THEN 1 WHEN vs[1] = top THEN CASE WHEN greatest(CASE WHEN h1 <> vs[1] THEN h1 ELSE 0 END, CASE WHEN h2 <> vs[1] THEN h2 ELSE 0 END) >= 11 THEN 1 ELSE 2 END ELSE 3 END
                WHEN outs >= 10 THEN 4 WHEN outs >= 3 THEN 5 ELSE 6 END AS bucket_idx FROM kz
            )"""


def oracle_sql() -> dict[str, str]:
    start = f"WITH {_LOG[: _LOG.index('), st AS')]}), {_HANDS}"
    return {k: v.replace("HH", start, 1).replace("CARDS", _CARDS) if v.startswith("HH") else v for k, v in _all().items()}


def _all_strengths() -> str:
    return """sq AS (
              SELECT o_orderkey, category, kickers, vals[1] AS h1, vals[2] AS h2, suits[1] AS t1, suits[2] AS t2, vals[3:7] AS b, list_sort(list_distinct(vals[3:7])) AS u,
                     len(list_distinct(suits[3:7])) = 1 AS mono, list_max(vals[3:7]) AS top,
                     list_transform(range(0, 4), lambda x: len(list_filter(suits, lambda y: y = x))) AS per,
                     CASE WHEN list_contains(vals, 14) THEN list_append(list_distinct(vals), 1) ELSE list_distinct(vals) END AS lo
              FROM bs JOIN dl USING (o_orderkey)
            ), wq AS (
              SELECT *, len(u) < 5 AS paired, len(list_filter(range(1, len(u)), lambda i: u[i + 1] - u[i] <= 2)) >= 3 AS wet, list_position(per, list_max(per)) - 1 AS fs,
                     list_filter(range(1, 11), lambda t: len(list_filter(lo, lambda y: y >= t AND y <= t + 4)) = 4) AS win,
                     (CASE WHEN h1 > top THEN 1 ELSE 0 END) + (CASE WHEN h2 > top THEN 1 ELSE 0 END) AS over,
                     greatest(CASE WHEN h1 <> kickers[1] THEN h1 ELSE 0 END, CASE WHEN h2 <> kickers[1] THEN h2 ELSE 0 END) AS kick
              FROM sq
            ), oq AS (
              SELECT *, CASE WHEN category > 0 THEN 0 ELSE (CASE WHEN list_max(per) = 4 THEN 9 ELSE 0 END)
                + CASE WHEN len(list_filter(win, lambda t: NOT list_contains(lo, t) OR NOT list_contains(lo, t + 4))) > 0 THEN 8 WHEN len(win) > 0 THEN 4 ELSE 0 END
                + CASE over WHEN 2 THEN 6 WHEN 1 THEN 3 ELSE 0 END END AS outs FROM wq
            )
            SELECT o_orderkey, ['high_card', 'pair', 'two_pair', 'trips', 'straight', 'flush', 'full_house', 'quads', 'straight_flush'][category + 1] AS hand_type, outs,
              CASE category WHEN 8 THEN 'nuts/near-nuts' WHEN 7 THEN 'nuts/near-nuts' WHEN 6 THEN 'nuts/near-nuts'
                WHEN 5 THEN CASE WHEN (t1 = fs AND h1 = 14) OR (t2 = fs AND h2 = 14) THEN 'nuts/near-nuts' WHEN mono THEN 'strong made' ELSE 'nuts/near-nuts' END
                WHEN 4 THEN CASE WHEN paired OR mono THEN 'strong made' ELSE 'nuts/near-nuts' END
                WHEN 3 THEN CASE WHEN h1 = h2 AND list_contains(b, h1) AND NOT (mono OR wet) THEN 'nuts/near-nuts' ELSE 'strong made' END
                WHEN 2 THEN CASE WHEN wet THEN 'medium made' ELSE 'strong made' END
                WHEN 1 THEN CASE WHEN kickers[1] > top THEN 'strong made' WHEN kickers[1] = top THEN CASE WHEN kick >= 11 THEN 'strong made' ELSE 'medium made' END ELSE 'weak made' END
                ELSE CASE WHEN outs >= 10 THEN 'strong draw' WHEN outs >= 3 THEN 'weak draw' ELSE 'air' END END AS bucket
            FROM oq"""


def _strengths_sql() -> str:
    """The evaluator's SQL over (hole, board) pairs of live players, numbered like deals."""
    sy = """HH, CARDS, mk AS (SELECT path, pos, street FROM bo JOIN sp USING (path) UNION ALL SELECT path, pos, street FROM sr WHERE street > 0
        ), lv AS (
          SELECT mk.path, mk.pos, mk.street, ho.player, ho.c1, ho.c2 FROM mk JOIN ho USING (path)
          WHERE NOT EXISTS (SELECT 1 FROM sr f WHERE f.path = mk.path AND f.seat = ho.seat AND f.fold = 1 AND f.pos <= mk.pos)
        ), lb AS (SELECT lv.*, board FROM lv JOIN bo ON bo.path = lv.path AND bo.street = lv.street
        ), dk AS (SELECT DISTINCT c1, c2, board, [c1, c2] || list_transform(range(0, length(board) // 2), lambda i: substr(board, 2 * i + 1, 2)) AS cards FROM lb
        ), dl AS (
          SELECT row_number() OVER () AS o_orderkey, c1, c2, board, cards, list_transform(cards, lambda c: 15 - instr('AKQJT98765432', substr(c, 1, 1))) AS vals, list_transform(cards, lambda c: instr('SHDC', substr(c, 2, 1)) - 1) AS suits FROM dk
        ), """
    score = _SCORE.replace("FROM dl, ms, range(1, 8) t(i) WHERE (m >> (i - 1)) & 1 = 1", "FROM dl, ms, range(1, 8) t(i) WHERE (m >> (i - 1)) & 1 = 1 AND m < 1 << len(cards)")
    rest = _all_strengths().replace("vals[3:7]", "vals[3:]").replace("suits[3:7]", "suits[3:]").replace("len(u) < 5 AS paired", "len(u) < len(b) AS paired").replace("CASE WHEN wet THEN 'medium made'", "CASE WHEN wet AND len(b) >= 4 THEN 'medium made'")
    rest = rest.replace("SELECT o_orderkey, ['high_card'", "SELECT o_orderkey AS z, ['high_card'")
    return f"{sy}{score}, {rest}".replace("SELECT o_orderkey AS z", ", fin AS (SELECT o_orderkey AS z") + """) SELECT lb.path, pos::INTEGER AS seq, player, c1 || c2 AS hole, board, bucket, hand_type, outs::INTEGER AS outs FROM lb JOIN dl USING (c1, c2, board) JOIN fin ON z = o_orderkey"""


def _all() -> dict[str, str]:
    return {
        "event_replay": f"WITH {_LOG} SELECT path, seq, bucket, round(amount, 4) AS amount, round(pot, 4) AS pot, round(last_bet, 4) AS last_bet, raises, state_key FROM ks",
        "bucket_counts": """
            SELECT CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 WHEN l_quantity * 3 < 50 THEN 2 WHEN l_quantity * 3 < 100 THEN 3 ELSE 4 END AS bucket,
                   count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""",
        "state_keys": f"WITH {_LOG} SELECT state_key, count(*) AS n, round(avg(pot), 6) AS mean_pot FROM ks GROUP BY state_key",
        "key_parts": f"WITH {_LOG} SELECT position, active, facing, raise_label AS raises, spr, count(*) AS n FROM ks GROUP BY ALL",
        "hand_classes": f"""WITH {_CLASSES}, {_DEALS}, hd AS (
              SELECT substr(cards[1], 1, 1) AS r1, substr(cards[2], 1, 1) AS r2, vals[1] AS v1, vals[2] AS v2, suits[1] = suits[2] AS s FROM dl
            ), nm AS (SELECT CASE WHEN v1 >= v2 THEN r1 || r2 ELSE r2 || r1 END || CASE WHEN v1 = v2 THEN '' WHEN s THEN 's' ELSE 'o' END AS hand_class FROM hd
            ), ct AS (SELECT hand_class, count(*) AS n FROM nm GROUP BY 1)
            SELECT class_id, hand_class, high, low, pair, suited, gap, broadways, has_ace, round(strength, 9) AS strength,
                   CASE WHEN pair THEN 6 WHEN suited THEN 4 ELSE 12 END AS combos, coalesce(n, 0) AS n FROM hc LEFT JOIN ct USING (hand_class)""",
        "action_table": f"WITH {_LOG}, {_CLASSES}, {_table(0.5)} SELECT state_key, class_id, bucket, round(lik, 9) AS lik, round(5e0 * lik, 9) AS alpha FROM lk",
        "strength_table": f"WITH {_LOG}, {_PSI}, us AS (SELECT bucket, count(*) AS n FROM ev GROUP BY bucket) SELECT bucket_idx, strength, bucket, round(psi, 9) AS psi, n FROM ps JOIN us USING (bucket)",
        "priors": f"""WITH {_CLASSES}, {_DEALS}, dd AS (SELECT cards[1] AS a, cards[2] AS b, count(*) AS uses FROM dl GROUP BY 1, 2
            ), cc AS (SELECT a, b, uses, class_id, count(*) FILTER (WHERE c1 NOT IN (a, b) AND c2 NOT IN (a, b)) AS n FROM dd, cb GROUP BY ALL)
            SELECT class_id, sum(n * uses)::BIGINT AS combos, round(sum(n / 1225e0 * uses), 6) AS prior_mass FROM cc GROUP BY class_id""",
        "range_filter": f"""WITH {_LOG}, {_CLASSES}, {_table(0.0)}, {_post("'AH', 'KH'")}, {_RANGE}
            SELECT path, row_number() OVER (PARTITION BY path ORDER BY round(p, 12) DESC, class_id)::INTEGER AS rank, hand_class, round(p, 9) AS p, n AS n_decisions, round(log_likelihood, 8) AS log_likelihood
            FROM po QUALIFY rank <= 3""",
        "range_summary": f"""WITH {_LOG}, {_CLASSES}, {_table(0.0)}, {_post("'AH', 'KH'")}, {_RANGE}
            SELECT path, round(1 / sum(p * p), 6) AS effective_size, round(max(p), 9) AS top_probability, round(sum(p), 9) AS total FROM po GROUP BY path""",
        "evaluator": f"WITH {_DEALS}, {_SCORE} SELECT o_orderkey, array_to_string(cards, '') AS cards, category, array_to_string(kickers, ',') AS kickers FROM bs JOIN dl USING (o_orderkey)",
        "board_texture": f"""WITH {_DEALS}, bd AS (
              SELECT o_orderkey, vals[3:7] AS v, suits[3:7] AS s, list_sort(list_distinct(vals[3:7])) AS u FROM dl
            ), nr AS (SELECT *, len(list_filter(range(1, len(u)), lambda i: u[i + 1] - u[i] <= 2)) AS near FROM bd)
            SELECT o_orderkey, len(list_distinct(s)) = 1 AS monotone, len(list_distinct(s)) < 5 AS two_tone, len(u) < 5 AS paired, near >= 2 AS connected, near >= 3 AS very_connected, list_max(v) AS high_card FROM nr""",
        "strengths": f"WITH {_DEALS}, {_SCORE}, {_all_strengths()}",
        "collapse": f"""WITH {_CLASSES}, {_DEALS}, fb AS (
              SELECT DISTINCT array_to_string(cards[3:5], '') AS board, cards[3:5] AS b FROM dl
            ), {_RATED}, m AS (SELECT board, bucket_idx, count(*) AS n FROM kr GROUP BY ALL
            ), a AS (SELECT board, i::INTEGER AS bucket_idx FROM fb, range(0, 7) t(i))
            SELECT board, bucket_idx, {_NAMES}[bucket_idx + 1] AS strength, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY board), 9) AS p FROM a LEFT JOIN m USING (board, bucket_idx)""",
        "strength_filter": f"""WITH {_LOG}, {_PSI}, lf AS (
              SELECT path, bucket_idx, sum(ln(psi)) AS l FROM lg JOIN ps USING (bucket) GROUP BY path, bucket_idx
            ), wf AS (SELECT path, bucket_idx, exp(l - max(l) OVER w) / 7 AS u, max(l) OVER w AS top FROM lf WINDOW w AS (PARTITION BY path)
            ), pf AS (SELECT *, u / sum(u) OVER w AS p, ln(sum(u) OVER w) + top AS ll FROM wf WINDOW w AS (PARTITION BY path))
            SELECT path, round(sum(p * (6 - bucket_idx) / 6e0), 8) AS expected_strength, round(1 / sum(p * p), 7) AS effective_size, round(any_value(ll), 7) AS log_likelihood FROM pf GROUP BY path""",
        "filter_steps": f"""WITH {_LOG}, {_CLASSES}, {_table(0.0)}, {_post("'none'")}, sp AS (
              SELECT path, seq, bucket, class_id, prior * exp(sum(ln(lik)) OVER (PARTITION BY path, class_id ORDER BY seq)) AS w FROM ks JOIN lk USING (state_key, bucket) JOIN pp USING (class_id)
            ), sz AS (SELECT path, seq AS step, any_value(bucket) AS action_bucket, sum(w) AS z, sum(w * w) AS zz, max(w) AS mx FROM sp GROUP BY path, seq)
            SELECT path, step, action_bucket, round(z / coalesce(lag(z) OVER (PARTITION BY path ORDER BY step), 1e0), 8) AS evidence, round(z * z / zz, 5) AS effective_size, round(mx / z, 8) AS top_probability FROM sz""",
        "strength_steps": f"""WITH {_LOG}, {_PSI}, lf AS (
              SELECT path, seq AS step, bucket AS action_bucket, bucket_idx, sum(ln(psi)) OVER (PARTITION BY path, bucket_idx ORDER BY seq) AS l FROM lg JOIN ps USING (bucket)
            ), wf AS (SELECT *, exp(l - max(l) OVER w) / 7 AS u, max(l) OVER w AS top FROM lf WINDOW w AS (PARTITION BY path, step)
            ), zf AS (SELECT path, step, any_value(action_bucket) AS action_bucket, ln(sum(u)) + any_value(top) AS lz, sum(u) * sum(u) / sum(u * u) AS e, max(u) / sum(u) AS tp, list(bucket_idx ORDER BY round(u, 12) DESC, bucket_idx)[1] AS b FROM wf GROUP BY path, step)
            SELECT path, step::INTEGER AS step, action_bucket, round(exp(lz - coalesce(lag(lz) OVER (PARTITION BY path ORDER BY step), 0e0)), 8) AS evidence, round(e, 6) AS effective_size, {_NAMES}[b + 1] AS top_strength, round(tp, 8) AS top_probability FROM zf""",
        "strength_table_tilted": f"""WITH {_LOG}, {_PSI}, us AS (SELECT bucket, count(*) AS n FROM ev GROUP BY bucket
            ), tl AS (SELECT *, bucket_idx / 6e0 AS w FROM ps
            ), ts AS (SELECT bucket_idx, strength, bucket, exp(ln(greatest(psi, 1e-9)) + 0.5e0 * CASE bucket WHEN 0 THEN -w WHEN 1 THEN w - 0.3e0 WHEN 2 THEN 0.8e0 * (w - 0.2e0) WHEN 3 THEN 0.6e0 * (w - 0.1e0) ELSE 0.5e0 * w END) AS e FROM tl
            ), tp AS (SELECT *, e / sum(e) OVER (PARTITION BY bucket_idx) AS psi FROM ts) SELECT bucket_idx, strength, bucket, round(psi, 9) AS psi, n FROM tp JOIN us USING (bucket)""",
        "hand_postflop": f"""{_pair(0.0)}, {_PSI}, fpx AS (SELECT bo.path, board FROM bo JOIN sp USING (path) WHERE street = 1
            ), fb AS (SELECT DISTINCT board, [substr(board, 1, 2), substr(board, 3, 2), substr(board, 5, 2)] AS b FROM fpx
            ), {_RATED}, la AS (SELECT path, player AS target, bucket, count(*) AS c FROM sr WHERE street > 0 GROUP BY ALL
            ), lx AS (SELECT path, target, bucket_idx, sum(c * ln(psi)) AS l, sum(c) AS n FROM la JOIN ps USING (bucket) GROUP BY path, target, bucket_idx
            ), st0 AS (SELECT path, observer, target, board, bucket_idx, sum(p) AS m FROM po JOIN fpx USING (path) JOIN kr USING (board, class_id) GROUP BY ALL
            ), st1 AS (
              SELECT pr.*, lx.bucket_idx, l, n, coalesce(m, 0e0) / sum(m) OVER (PARTITION BY pr.path, pr.observer, pr.target) AS s
              FROM (SELECT DISTINCT path, observer, target, board FROM st0) pr JOIN lx ON lx.path = pr.path AND lx.target = pr.target
                LEFT JOIN st0 ON st0.path = pr.path AND st0.observer = pr.observer AND st0.target = pr.target AND st0.bucket_idx = lx.bucket_idx
            ), st2 AS (SELECT *, max(CASE WHEN s > 0 THEN l END) OVER w AS top, s * exp(l - max(CASE WHEN s > 0 THEN l END) OVER w) AS u FROM st1 WINDOW w AS (PARTITION BY path, observer, target)
            ), st3 AS (SELECT *, u / sum(u) OVER w AS q, ln(sum(u) OVER w) + top AS ll FROM st2 WINDOW w AS (PARTITION BY path, observer, target))
            SELECT path, observer, target, board, any_value(n)::BIGINT AS n_actions, round(sum(s * (6 - bucket_idx) / 6e0), 7) AS strength_before, round(sum(q * (6 - bucket_idx) / 6e0), 7) AS strength_after,
                   round(1 / sum(q * q), 6) AS effective_size, round(any_value(ll), 7) AS log_likelihood FROM st3 GROUP BY path, observer, target, board""",
        "priors_on_boards": f"""WITH {_CLASSES}, {_DEALS}, dd AS (SELECT DISTINCT cards[1:5] AS d FROM dl
            ), cc AS (SELECT d, class_id, count(*) FILTER (WHERE NOT list_contains(d, c1) AND NOT list_contains(d, c2)) AS n FROM dd, cb GROUP BY ALL)
            SELECT class_id, sum(n)::BIGINT AS combos, round(sum(n / 1081e0), 5) AS prior_mass, count(*) FILTER (WHERE n = 0) AS n_gone FROM cc GROUP BY class_id""",
        "hand_replay": """HH SELECT path, pos::INTEGER AS seq, street::INTEGER AS street, action_index::INTEGER AS action_index, player, verb, amount, pot_before::BIGINT AS pot_before, pot_after::BIGINT AS pot_after, stack_before::BIGINT AS stack_before,
            level_before::INTEGER AS level_before, level_after::INTEGER AS level_after, live::INTEGER AS live, state_key, bucket::INTEGER AS bucket, violation FROM rp""",
        "violations": "HH SELECT violation, count(*) AS n, count(DISTINCT path) AS n_hands FROM rp WHERE violation IS NOT NULL GROUP BY violation",
        "hand_boards": "HH, CARDS SELECT path, street::INTEGER AS street, board FROM bo",
        "hand_holes": """HH, CARDS, nm AS (SELECT *, instr('AKQJT98765432', substr(c1, 1, 1)) AS i, instr('AKQJT98765432', substr(c2, 1, 1)) AS j FROM ho)
            SELECT path, player, c1 || c2 AS cards, CASE WHEN i <= j THEN substr(c1, 1, 1) || substr(c2, 1, 1) ELSE substr(c2, 1, 1) || substr(c1, 1, 1) END
              || CASE WHEN i = j THEN '' WHEN substr(c1, 2, 1) = substr(c2, 2, 1) THEN 's' ELSE 'o' END AS hand_class FROM nm""",
        "hand_states": """HH, CARDS, mk AS (
              SELECT path, -1 AS pos, 0 AS street, NULL AS seat FROM sp UNION ALL SELECT path, pos, street, NULL FROM bo JOIN sp USING (path) UNION ALL SELECT path, pos, street, seat FROM sr
            ), sx AS (
              SELECT mk.path, mk.pos, mk.street, mk.seat, sp.n, sp.stack, i, coalesce(sum(sr.contrib) FILTER (WHERE sr.seat = i), 0) AS paid, coalesce(sum(sr.contrib), 0) AS all_paid, coalesce(max(sr.fold) FILTER (WHERE sr.seat = i), 0) = 0 AS alive
              FROM mk JOIN sp USING (path) JOIN range(1, 7) t(i) ON i <= n LEFT JOIN sr ON sr.path = mk.path AND sr.pos <= mk.pos GROUP BY ALL
            ), sy AS (
              SELECT path, pos, street, any_value(seat) AS seat, any_value(n) AS n, string_agg(alive::VARCHAR, ',' ORDER BY i) AS alive, string_agg((stack - CASE i WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 0 END - paid)::BIGINT::VARCHAR, ',' ORDER BY i) AS stacks,
                     150 + any_value(all_paid) AS pot, coalesce(min(i) FILTER (WHERE alive AND i > seat), min(i) FILTER (WHERE alive)) AS nx, min(i) FILTER (WHERE alive) AS fl FROM sx GROUP BY path, pos, street)
            SELECT sy.path, sy.pos::INTEGER AS seq, sy.street::INTEGER AS street, alive, stacks, ['ann', 'bob', 'cyd', 'dan', 'eve', 'fay'][CASE WHEN seat IS NOT NULL THEN nx WHEN sy.street > 0 THEN fl WHEN n = 2 THEN 1 ELSE 3 END] AS player_to_act, pot::BIGINT AS pot, board
            FROM sy LEFT JOIN bo ON bo.path = sy.path AND bo.street = sy.street""",
        "hand_history": """HH SELECT a.path, a.pos::INTEGER AS seq, coalesce(string_agg(b.player || ':' || b.bucket || ':' || b.level_after || ':' || b.amount, ';' ORDER BY b.pos), '') AS history
            FROM sr a LEFT JOIN sr b ON b.path = a.path AND b.street = a.street AND b.pos < a.pos GROUP BY a.path, a.pos""",
        "hand_files": """HH, la AS (SELECT path, 'p' || seat || ' ' || verb || coalesce(' ' || raise_to, '') AS last_action FROM ac QUALIFY row_number() OVER (PARTITION BY path ORDER BY pos DESC) = 1)
            SELECT 'logs/' || uid || '/' || key || '.phh' AS path, uid::VARCHAR AS session_id, key::INTEGER AS hand_no, 'NT' AS variant, key::INTEGER AS hand, 100::BIGINT AS min_bet, array_to_string(['ann', 'bob', 'cyd', 'dan', 'eve', 'fay'][1:n], ',') AS players,
                   stack::BIGINT AS stack, (n + m + (m - 1) // 2 + CASE WHEN m >= 5 THEN 1 ELSE 0 END)::INTEGER AS n_actions, last_action FROM hh JOIN la USING (path)""",
        "labels": """HH, st AS (SELECT i AS seat, n AS players, count(*) AS c FROM hh, range(1, 7) t(i) WHERE i <= n GROUP BY ALL)
            SELECT seat::INTEGER AS seat, players::INTEGER AS players, CASE seat WHEN 1 THEN 'sb' WHEN 2 THEN 'bb' ELSE CASE players WHEN 3 THEN 'b' WHEN 4 THEN ['utg', 'button'][seat - 2] WHEN 5 THEN ['utg', 'co', 'button'][seat - 2] ELSE ['utg', 'hj', 'co', 'button'][seat - 2] END END AS position,
                   ['sb', 'bb', 'utg', 'hj', 'co', 'btn'][seat] AS label, c AS n FROM st""",
        "hand_ranges": f"""{_pair(0.0)} SELECT path, observer, target, row_number() OVER (PARTITION BY path, observer, target ORDER BY round(p, 12) DESC, class_id)::INTEGER AS rank, hand_class, round(p, 9) AS p, n AS n_decisions, round(log_likelihood, 8) AS log_likelihood
            FROM po QUALIFY rank <= 3""",
        "hand_summaries": f"""{_pair(0.5)} SELECT path, observer, target, any_value(d1 || d2) AS dead, round(1 / sum(p * p), 5) AS effective_size, round(any_value(log_likelihood), 8) AS log_likelihood, any_value(n) AS n_decisions, count(*)::INTEGER AS classes,
            round(sum(p * class_id), 6) AS mean_class, round(max(p) FILTER (WHERE hand_class = 'AKs'), 9) AS aks FROM po GROUP BY path, observer, target""",
        "hand_results": f"""{_pair(0.5)}, hx AS (SELECT path, (row_number() OVER (PARTITION BY uid ORDER BY key, path) - 1)::INTEGER AS hand_index FROM hh
            ), dc AS (SELECT path, player AS target, string_agg(action_index || ':' || state_key || ':' || bucket || ':' || amount, ';' ORDER BY action_index) AS decisions FROM sr WHERE street = 0 GROUP BY ALL
            ), tc AS (SELECT path, observer, target, d1 || d2 AS dead, hand_class AS top_class, round(p, 9) AS top_probability, round(log_likelihood, 8) AS log_likelihood FROM po
              QUALIFY row_number() OVER (PARTITION BY path, observer, target ORDER BY round(p, 12) DESC, class_id) = 1)
            SELECT split_part(path, '/', 1) AS session, hand_index, path, observer, target, list_position(['ann', 'bob', 'cyd', 'dan', 'eve', 'fay'], observer)::INTEGER - 1 AS observer_at,
              list_position(['ann', 'bob', 'cyd', 'dan', 'eve', 'fay'], target)::INTEGER - 1 AS target_at, dead, 0.5e0 AS phi, decisions, top_class, top_probability, log_likelihood
            FROM tc JOIN hx USING (path) JOIN dc USING (path, target)""",
        "hand_true_class": f"""{_pair(0.0)}, nm AS (SELECT *, instr('AKQJT98765432', substr(c1, 1, 1)) AS i, instr('AKQJT98765432', substr(c2, 1, 1)) AS j FROM ho
            ), nc AS (SELECT path, player AS target, CASE WHEN i <= j THEN substr(c1, 1, 1) || substr(c2, 1, 1) ELSE substr(c2, 1, 1) || substr(c1, 1, 1) END || CASE WHEN i = j THEN '' WHEN substr(c1, 2, 1) = substr(c2, 2, 1) THEN 's' ELSE 'o' END AS hand_class FROM nm)
            SELECT path, observer, target, round(p, 9) AS true_class_probability FROM po JOIN nc USING (path, target, hand_class)""",
        "hand_temperature": " UNION ALL ".join(f"(SELECT * FROM ({_pair(phi)}, lp AS (SELECT target, observer, path, any_value(log_likelihood) AS l FROM po GROUP BY ALL) SELECT target, {phi}e0 AS phi, round(sum(l), 5) AS log_likelihood FROM lp GROUP BY target))" for phi in (-0.5, 0.0, 0.5)),
        "hand_strengths": _strengths_sql(),
    }
