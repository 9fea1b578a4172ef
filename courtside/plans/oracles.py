"""The registered queries' equivalents in plain SQL, over the driver's tables."""

from __future__ import annotations

from ..schema import CATEGORICAL, FEATURES

_SIDE = """concat('P', cast({k} AS VARCHAR)) AS {s}_name,
  CASE WHEN {k} % 10 < 7 THEN 'R' WHEN {k} % 10 < 9 THEN 'L' END AS {s}_hand,
  CASE WHEN {k} % 17 <> 5 THEN cast(1 + ({k} * 13 + month(o_orderdate)) % 200 AS DOUBLE) END AS {s}_rank,
  CASE WHEN {k} % 11 <> 0 THEN cast(165 + ({k} * 7) % 40 AS DOUBLE) END AS {s}_ht,
  CASE ({k} + o_orderkey) % 4 WHEN 0 THEN cast(1 + ({k} + o_orderkey) % 32 AS VARCHAR) WHEN 1 THEN 'WC' END AS {s}_seed,
  CASE WHEN {k} % 23 <> 0 THEN cast(18 + {k} % 15 + year(o_orderdate) - 1995 AS DOUBLE) END AS {s}_age"""
_EVENT = """SELECT rn, split, match_num, tourney_id, coalesce(surface, 'Unknown') AS surface, {m}_name AS player, {o}_name AS opponent, {m}_hand AS hand, {o}_hand AS opp_hand, {m}_rank AS rank, {m}_ht AS ht, {m}_seed AS seed, {m}_age AS age, {won} AS won FROM m"""
_CTES = [
    ("cnt", "SELECT count(*) AS n FROM supplier"),
    ("pa", "SELECT o.*, n, (o_orderkey * 7919 + o_custkey) % n AS a FROM orders o, cnt"),
    ("pb", "SELECT *, (a + 1 + (o_custkey * 31 + o_orderkey) % (n - 1)) % n AS b, cast(round(o_totalprice * 100) AS BIGINT) AS cents FROM pa"),
    ("pw", "SELECT pb.*, (sa.s_acctbal >= sb.s_acctbal) = (cents % 10 < 7) AS same FROM pb JOIN supplier sa ON sa.s_suppkey = a JOIN supplier sb ON sb.s_suppkey = b"),
    ("pk", "SELECT *, CASE WHEN same THEN a ELSE b END AS w, CASE WHEN same THEN b ELSE a END AS l FROM pw"),
    ("matches", f"SELECT o_orderkey AS match_num, cast(date_trunc('month', o_orderdate) AS DATE) AS tourney_date, concat(cast(year(o_orderdate) AS VARCHAR), '-', lpad(cast(month(o_orderdate) AS VARCHAR), 2, '0')) AS tourney_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Hard' WHEN '2-HIGH' THEN 'Clay' WHEN '3-MEDIUM' THEN 'Grass' WHEN '4-NOT SPECIFIED' THEN 'Carpet' END AS surface, {_SIDE.format(k='w', s='winner')}, {_SIDE.format(k='l', s='loser')} FROM pk"),
    ("tl", "SELECT *, row_number() OVER (ORDER BY tourney_date, match_num) - 1 AS rn, count(*) OVER () AS nm FROM matches"),
    ("m", "SELECT *, CASE WHEN rn < nm // 2 THEN 'initial' WHEN rn < (nm * 3) // 4 THEN 'next' ELSE 'final' END AS split FROM tl"),
    ("e", f"{_EVENT.format(m='winner', o='loser', won=1)} UNION ALL {_EVENT.format(m='loser', o='winner', won=0)}"),
    ("s", "SELECT * FROM e WHERE split <> 'final'"),
    ("five", "SELECT * FROM (VALUES ('Hard', 0), ('Clay', 1), ('Grass', 2), ('Carpet', 3), ('Unknown', 4)) AS t(surface, o)"),
    ("ap", "SELECT player, count(*) AS n FROM (SELECT winner_name AS player FROM m WHERE split = 'next' UNION ALL SELECT loser_name FROM m WHERE split = 'next') GROUP BY player"),
    ("act", "SELECT * FROM m WHERE split = 'next' AND winner_name IN (SELECT player FROM ap WHERE n >= 10) AND loser_name IN (SELECT player FROM ap WHERE n >= 10)"),
    ("sw", "SELECT *, substr(md5(concat(cast(match_num AS VARCHAR), ':42')), 1, 1) < '8' AS swap FROM act"),
    ("pr", "SELECT match_num, rn, split, tourney_date, surface AS raw_surface, " + ", ".join(f"CASE WHEN swap THEN {x}_{c} ELSE {y}_{c} END AS {p}{'' if c == 'name' else '_' + c}" for c in ("name", "seed", "rank", "age", "ht", "hand") for p, x, y in (("player1", "winner", "loser"), ("player2", "loser", "winner"))) + ", CASE WHEN swap THEN 1 ELSE 2 END AS result FROM sw"),
    ("pd", """SELECT * REPLACE (try_cast(player1_seed AS DOUBLE) AS player1_seed, try_cast(player2_seed AS DOUBLE) AS player2_seed),
      CASE WHEN raw_surface IN ('Hard', 'Clay', 'Grass') THEN raw_surface ELSE 'Unknown' END AS surface FROM pr"""),
    ("df", """SELECT *, CASE surface WHEN 'Clay' THEN 0 WHEN 'Grass' THEN 1 WHEN 'Hard' THEN 2 ELSE 3 END AS surface_encoded,
      player1_rank - player2_rank AS rank_diff, ln(1 + abs(player1_rank - player2_rank)) AS log_rank_diff,
      coalesce((player1_rank <= 10 AND player2_rank > 10) OR (player2_rank <= 10 AND player1_rank > 10), false) AS top_10_vs_not,
      player1_age - player2_age AS age_diff, coalesce((player1_age < 25 AND player2_age > 30) OR (player2_age < 25 AND player1_age > 30), false) AS young_vs_old,
      player1_seed - player2_seed AS seed_diff, (player1_seed IS NULL) <> (player2_seed IS NULL) AS seeded_vs_unseeded,
      player1_ht - player2_ht AS height_diff, coalesce((player1_ht > 190 AND player2_ht < 180) OR (player2_ht > 190 AND player1_ht < 180), false) AS tall_vs_short,
      coalesce(player1_hand = player2_hand, false) AS same_hand, coalesce((player1_hand = 'L' AND player2_hand = 'R') OR (player1_hand = 'R' AND player2_hand = 'L'), false) AS left_vs_right FROM pd"""),
    ("l5", "SELECT player, avg(won) AS last_5 FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY rn DESC) AS k FROM s) WHERE k <= 5 GROUP BY player"),
    ("l10", "SELECT player, avg(won) AS last_10 FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY rn DESC) AS k FROM s) WHERE k <= 10 GROUP BY player"),
    ("sl", "SELECT player, surface, avg(won) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY player, surface ORDER BY rn DESC) AS k FROM s) WHERE k <= 10 GROUP BY player, surface"),
    ("h2h", "SELECT player, opponent, count(*) AS matches, sum(won) AS wins FROM s GROUP BY player, opponent"),
    ("grid", "SELECT p.player, f.surface, f.o, count(s.won) AS matches, coalesce(sum(s.won), 0) AS wins FROM (SELECT DISTINCT player FROM s) p CROSS JOIN five f LEFT JOIN s ON s.player = p.player AND s.surface = f.surface GROUP BY ALL"),
    ("pref", "SELECT player, arg_max(surface, (CASE WHEN matches > 0 THEN wins / matches ELSE 0.0 END, -o)) AS preferred_surface FROM grid GROUP BY player"),
    ("ends", "SELECT player, max(CASE WHEN won = 1 THEN rn END) AS last_win, max(CASE WHEN won = 0 THEN rn END) AS last_loss FROM s GROUP BY player"),
    ("strk", "SELECT s.player, count(CASE WHEN rn > coalesce(last_loss, -1) THEN 1 END) AS win_streak, count(CASE WHEN rn > coalesce(last_win, -1) THEN 1 END) AS loss_streak FROM s JOIN ends ON s.player = ends.player GROUP BY s.player"),
    ("lat", "SELECT player, max_by(rn, rn) AS rn, " + ", ".join(f"(max_by({{'v': {c}}}, rn)).v AS latest_{c}" for c in ("rank", "ht", "hand", "seed", "age")) + " FROM s GROUP BY player"),
    ("vs", "SELECT player, " + ", ".join(f"count(CASE WHEN opp_hand = '{h}' THEN 1 END) AS matches_vs_{k}, count(CASE WHEN opp_hand = '{h}' AND won = 1 THEN 1 END) AS wins_vs_{k}" for h, k in (("R", "right"), ("L", "left"))) + " FROM s GROUP BY player"),
    ("tot", "SELECT player, count(*) AS matches, cast(sum(won) AS BIGINT) AS wins, sum(won) / count(*) AS win_pct FROM s GROUP BY player"),
    ("pf", """SELECT df.*, coalesce(a5.last_5, 0) AS player1_last_5_win_percentage, coalesce(b5.last_5, 0) AS player2_last_5_win_percentage,
      coalesce(a10.last_10, 0) AS player1_last_10_win_percentage, coalesce(b10.last_10, 0) AS player2_last_10_win_percentage,
      coalesce(asl.rate, 0) AS player1_surface_last_10_win_percentage, coalesce(bsl.rate, 0) AS player2_surface_last_10_win_percentage,
      coalesce(ap_.preferred_surface, 'Hard') AS player1_preferred_surface, coalesce(bp.preferred_surface, 'Hard') AS player2_preferred_surface,
      cast(coalesce(ah.wins, 0) AS BIGINT) AS head_to_head_wins_p1, cast(coalesce(bh.wins, 0) AS BIGINT) AS head_to_head_wins_p2
      FROM df LEFT JOIN l5 a5 ON a5.player = player1 LEFT JOIN l5 b5 ON b5.player = player2 LEFT JOIN l10 a10 ON a10.player = player1 LEFT JOIN l10 b10 ON b10.player = player2
      LEFT JOIN sl asl ON asl.player = player1 AND asl.surface = df.surface LEFT JOIN sl bsl ON bsl.player = player2 AND bsl.surface = df.surface
      LEFT JOIN pref ap_ ON ap_.player = player1 LEFT JOIN pref bp ON bp.player = player2
      LEFT JOIN h2h ah ON ah.player = player1 AND ah.opponent = player2 LEFT JOIN h2h bh ON bh.player = player2 AND bh.opponent = player1"""),
    ("fx", "SELECT *, surface = player1_preferred_surface AS player1_surface_match, surface = player2_preferred_surface AS player2_surface_match, cast(surface = player1_preferred_surface AS INT) - cast(surface = player2_preferred_surface AS INT) AS surface_preference_diff FROM pf"),
    ("pit", """SELECT player, rn, match_num, coalesce(avg(won) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS last_5, coalesce(avg(won) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS last_10,
      coalesce(avg(won) OVER (PARTITION BY player, surface ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS surface_last_10, cast(coalesce(sum(won) OVER (PARTITION BY player, opponent ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS h2h_wins FROM e WINDOW w AS (PARTITION BY player ORDER BY rn)"""),
    ("sofar", """SELECT e.player, e.rn, f.surface, f.o, sum(CASE WHEN e.surface = f.surface THEN 1 ELSE 0 END) OVER w AS matches, sum(CASE WHEN e.surface = f.surface THEN won ELSE 0 END) OVER w AS wins
      FROM e CROSS JOIN five f WINDOW w AS (PARTITION BY e.player, f.surface ORDER BY e.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    ("pitp", "SELECT player, rn, arg_max(surface, (CASE WHEN matches > 0 THEN wins / matches ELSE 0.0 END, -o)) AS preferred_surface FROM sofar GROUP BY player, rn"),
    ("pin", """SELECT df.*, a.last_5 AS player1_last_5_win_percentage, b.last_5 AS player2_last_5_win_percentage, a.last_10 AS player1_last_10_win_percentage, b.last_10 AS player2_last_10_win_percentage,
      a.surface_last_10 AS player1_surface_last_10_win_percentage, b.surface_last_10 AS player2_surface_last_10_win_percentage, ap_.preferred_surface AS player1_preferred_surface, bp.preferred_surface AS player2_preferred_surface,
      a.h2h_wins AS head_to_head_wins_p1, b.h2h_wins AS head_to_head_wins_p2
      FROM df JOIN pit a ON a.player = player1 AND a.match_num = df.match_num JOIN pit b ON b.player = player2 AND b.match_num = df.match_num JOIN pitp ap_ ON ap_.player = player1 AND ap_.rn = df.rn JOIN pitp bp ON bp.player = player2 AND bp.rn = df.rn"""),
    ("pinx", "SELECT *, surface = player1_preferred_surface AS player1_surface_match, surface = player2_preferred_surface AS player2_surface_match, cast(surface = player1_preferred_surface AS INT) - cast(surface = player2_preferred_surface AS INT) AS surface_preference_diff FROM pin"),
    ("aft", """SELECT player, opponent, surface, tourney_date AS known_at, rn, avg(won) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last_5, avg(won) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_10,
      avg(won) OVER (PARTITION BY player, surface ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS surface_last_10, sum(won) OVER (PARTITION BY player, opponent ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h2h_wins
      FROM (SELECT e.*, m.tourney_date FROM e JOIN m ON m.rn = e.rn) WINDOW w AS (PARTITION BY player ORDER BY rn)"""),
    ("aftp", """SELECT player, rn, arg_max(surface, (CASE WHEN matches > 0 THEN wins / matches ELSE 0.0 END, -o)) AS preferred_surface FROM (
      SELECT e.player, e.rn, f.surface, f.o, sum(CASE WHEN e.surface = f.surface THEN 1 ELSE 0 END) OVER w AS matches, sum(CASE WHEN e.surface = f.surface THEN won ELSE 0 END) OVER w AS wins
      FROM e CROSS JOIN five f WINDOW w AS (PARTITION BY e.player, f.surface ORDER BY e.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY player, rn"""),
    ("adf", "SELECT aft.*, preferred_surface FROM aft JOIN aftp ON aft.player = aftp.player AND aft.rn = aftp.rn QUALIFY row_number() OVER (PARTITION BY aft.player, known_at ORDER BY aft.rn DESC) = 1"),
    ("ads", "SELECT * FROM aft QUALIFY row_number() OVER (PARTITION BY player, surface, known_at ORDER BY rn DESC) = 1"),
    ("adh", "SELECT * FROM aft QUALIFY row_number() OVER (PARTITION BY player, opponent, known_at ORDER BY rn DESC) = 1"),
    ("ask", "SELECT df.*, cast(tourney_date + cast(match_num % 701 - 350 AS INT) AS DATE) AS asked FROM df"),
    ("fl", None),
]
_MED = ["player1_age", "player2_age", "player1_ht", "player2_ht", "rank_diff", "log_rank_diff", "age_diff", "seed_diff", "height_diff"] + [f"player{i}_{k}_win_percentage" for k in ("last_5", "last_10", "surface_last_10") for i in (1, 2)]
_FILL = {"player1_hand": "'U'", "player2_hand": "'U'", "player1_rank": "999", "player2_rank": "999", "player1_seed": "-1", "player2_seed": "-1"}
_CTES[-1] = ("fl", "SELECT fx.* REPLACE (" + ", ".join([f"coalesce({c}, {v}) AS {c}" for c, v in _FILL.items()] + [f"coalesce({c}, (SELECT median({c}) FROM fx)) AS {c}" for c in _MED]) + ") FROM fx")

#: The shared definitions with the state after all events, and with a selective limit in place of the reference's, which keeps the whole split.
_AFTER_ALL = [(k, "SELECT * FROM e" if k == "s" else v) for k, v in _CTES]
_SELECTIVE = [(k, v.replace("n >= 10", "n >= 75") if k == "act" else v) for k, v in _CTES]


def _with(tail: str, ctes: list[tuple[str, str]] = _CTES) -> str:
    """tail after those of the shared definitions that it needs."""
    import re

    need, names = set(), {k: v for k, v in ctes}
    todo = [tail]
    while todo:
        for w in set(re.findall(r"\b\w+\b", todo.pop())) & names.keys() - need:
            need.add(w)
            todo.append(names[w])
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes if k in need) + "\n" + tail if need else tail


def r(c: str, name: str | None = None) -> str:
    return f"round({c}, 6) AS {name or c.split('.')[-1]}"


FEATURE_COLUMNS = ["match_num", "player1", "player2", "result", "surface", "surface_encoded", "rank_diff", "log_rank_diff", "top_10_vs_not", "age_diff", "young_vs_old", "seed_diff", "seeded_vs_unseeded", "height_diff", "tall_vs_short", "same_hand", "left_vs_right"]
RATES = [f"player{i}_{k}_win_percentage" for k in ("last_5", "last_10", "surface_last_10") for i in (1, 2)]
LOOKED_UP = [*RATES, "player1_preferred_surface", "player2_preferred_surface", "head_to_head_wins_p1", "head_to_head_wins_p2", "player1_surface_match", "player2_surface_match", "surface_preference_diff"]
ROUNDED = {"log_rank_diff", *RATES, *_MED}


def _pick(columns: list[str]) -> str:
    return ", ".join(r(c) if c in ROUNDED else c for c in columns)


_ALL = "match_num, tourney_id, tourney_date, surface, " + ", ".join(f"{s}_{c}" for c in ("name", "hand", "rank", "ht", "seed", "age") for s in ("winner", "loser"))
_ALL_COLUMNS = ["tourney_id", "tourney_date", "surface", *(f"{s}_{c}" for c in ("name", "hand", "rank", "ht", "seed", "age") for s in ("winner", "loser")), "match_num"]
_MNA = "match_num, winner_name, loser_name"
_DIFF = ["rank_diff", "age_diff", "seed_diff", "height_diff"]
_SCALED = ["rank_diff", "age_diff", "player1_last_10_win_percentage"]
_H = "md5(concat(cast(match_num AS VARCHAR), ':42:holdout'))"

_CODE = "CASE {c} WHEN 'Clay' THEN 0.0 WHEN 'Grass' THEN 1.0 WHEN 'Hard' THEN 2.0 ELSE 3.0 END"
_NUMBERS = {c: f"cast({_CODE.format(c=c)} AS DOUBLE)" for c in CATEGORICAL}

SQL = {
    "s1_csv_scan": f"SELECT {_ALL} FROM matches",
    "s3_csv_sink": f"SELECT {_ALL} FROM matches",
    "s4_ensure_folder": "SELECT * FROM (VALUES ('there before', false), ('made', true), ('there after', true), ('made again', false)) AS t(step, answer)",
    "s5_season_scan": "SELECT cast(year(tourney_date) AS INT) AS source_year, count(*) AS n FROM matches WHERE year(tourney_date) BETWEEN 1993 AND 1996 GROUP BY 1",
    "s5_mixed_headers": "SELECT match_num, tourney_date, CASE WHEN year(tourney_date) NOT BETWEEN 1994 AND 1995 THEN surface END AS surface, winner_name, loser_name, winner_rank, CASE WHEN year(tourney_date) > 1995 THEN cast(match_num % 300 AS VARCHAR) END AS minutes, cast(year(tourney_date) AS INT) AS source_year FROM matches WHERE year(tourney_date) BETWEEN 1993 AND 1997",
    "s6_union_files": "SELECT match_num, winner_name, CASE WHEN match_num % 2 = 0 THEN loser_name END AS loser_name FROM matches",
    "s7_inline_literals": "SELECT * FROM (VALUES ('Clay', 0), ('Grass', 1), ('Hard', 2), ('Unknown', 3)) AS t(surface, code)",
    "s8_output_frame": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i / 8})" for i, f in enumerate(FEATURES)) + ") AS t(feature, importance)",
    "s9_profile_report": "SELECT tot.player, " + ", ".join(f"(SELECT round(CASE WHEN matches > 0 THEN wins / matches ELSE 0 END, 6) FROM grid WHERE grid.player = tot.player AND surface = '{x}') AS pct_{x.lower()}" for x in ("Hard", "Clay", "Grass")) + f", {r('win_pct')}, {r('last_5')}, " + ", ".join(f"round(CASE WHEN matches_vs_{k} > 0 THEN wins_vs_{k} / matches_vs_{k} ELSE 0 END, 6) AS pct_vs_{k}" for k in ("right", "left")) + ", coalesce(latest_rank <> 0 AND latest_rank <= 10, false) AS is_top_10, win_streak, loss_streak, preferred_surface FROM tot JOIN l5 ON l5.player = tot.player JOIN strk ON strk.player = tot.player JOIN pref ON pref.player = tot.player JOIN vs ON vs.player = tot.player JOIN lat ON lat.player = tot.player WHERE tot.player = 'P7'",
    "p1_add_columns": "SELECT match_num, winner_rank - loser_rank AS rank_diff, coalesce(surface, 'Unknown') AS surface FROM matches",
    "p2_side_swap": "SELECT match_num, player1, player2, player1_seed, player2_seed, player1_rank, player2_rank, player1_age, player2_age, player1_ht, player2_ht, player1_hand, player2_hand FROM pr",
    "p3_result_label": "SELECT match_num, result FROM pr",
    "p4_mask_filter": f"SELECT {_MNA} FROM matches WHERE winner_rank <= 20",
    "p5_membership_filter": f"SELECT {_MNA} FROM m WHERE winner_name IN (SELECT player FROM ap WHERE n >= 80) AND loser_name IN (SELECT player FROM ap WHERE n >= 80)",
    "p6_min_matches": f"SELECT {_MNA} FROM act",
    "p7_null_tests": "SELECT count(CASE WHEN surface IS NULL THEN 1 END) AS no_surface, count(CASE WHEN winner_seed IS NOT NULL THEN 1 END) AS seeded FROM matches",
    "p8_null_safe_logic": "SELECT match_num, coalesce(winner_rank <= 10 AND loser_rank > 10, false) AS favourite_won FROM matches",
    "p9_projection": f"SELECT {_pick(['match_num', 'rank_diff', 'log_rank_diff', 'top_10_vs_not', 'result'])} FROM df",
    "p10_text_columns": "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in _ALL_COLUMNS if c in ("tourney_id", "surface") or c.endswith(("_name", "_hand", "_seed"))) + ") AS t(\"column\")",
    "p11_schema": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_ALL_COLUMNS)) + ") AS t(position, \"column\")",
    "p12_row_slice": "SELECT match_num, rn FROM m WHERE rn >= 100 AND rn < 250",
    "p13_point_lookup": "SELECT player, matches, wins FROM tot WHERE player = 'P7'",
    "p14_either_side": "SELECT match_num, player1, player2 FROM pr WHERE player1 = 'P7' OR player2 = 'P7' OR player1 = 'P8' OR player2 = 'P8'",
    "p15_segment_routing": "SELECT match_num, player1_rank <= 10 OR player2_rank <= 10 AS is_top FROM fl",
    "p17_list_or_unknown": "SELECT match_num, CASE WHEN surface IN ('Hard', 'Clay', 'Grass') THEN surface ELSE 'Unknown' END AS surface FROM matches",
    "j1_full_outer_counts": "SELECT player, n FROM ap",
    "j1_single_aggregate_counts": "SELECT player, n FROM ap",
    "j2_form_lookup": f"SELECT match_num, {', '.join(r(c) for c in RATES[:4])}, player1_preferred_surface, player2_preferred_surface FROM pf",
    "j3_head_to_head_lookup": "SELECT match_num, head_to_head_wins_p1, head_to_head_wins_p2 FROM pf",
    "j4_surface_form_lookup": f"SELECT match_num, {', '.join(r(c) for c in RATES[4:])} FROM pf",
    "j2_as_of_form": "SELECT match_num, round(coalesce(a.last_5, 0), 6) AS player1_last_5_win_percentage, round(coalesce(b.last_5, 0), 6) AS player2_last_5_win_percentage, round(coalesce(a.last_10, 0), 6) AS player1_last_10_win_percentage, round(coalesce(b.last_10, 0), 6) AS player2_last_10_win_percentage, coalesce(a.preferred_surface, 'Hard') AS player1_preferred_surface, coalesce(b.preferred_surface, 'Hard') AS player2_preferred_surface FROM ask ASOF LEFT JOIN adf a ON a.player = player1 AND asked > a.known_at ASOF LEFT JOIN adf b ON b.player = player2 AND asked > b.known_at",
    "j3_as_of_head_to_head": "SELECT match_num, cast(coalesce(a.h2h_wins, 0) AS BIGINT) AS head_to_head_wins_p1, cast(coalesce(b.h2h_wins, 0) AS BIGINT) AS head_to_head_wins_p2 FROM ask ASOF LEFT JOIN adh a ON a.player = player1 AND a.opponent = player2 AND asked > a.known_at ASOF LEFT JOIN adh b ON b.player = player2 AND b.opponent = player1 AND asked > b.known_at",
    "j4_as_of_surface_form": "SELECT match_num, round(coalesce(a.surface_last_10, 0), 6) AS player1_surface_last_10_win_percentage, round(coalesce(b.surface_last_10, 0), 6) AS player2_surface_last_10_win_percentage FROM ask ASOF LEFT JOIN ads a ON a.player = player1 AND a.surface = ask.surface AND asked > a.known_at ASOF LEFT JOIN ads b ON b.player = player2 AND b.surface = ask.surface AND asked > b.known_at",
    "j5_semi_join": f"SELECT {_MNA} FROM m WHERE winner_name IN (SELECT player FROM ap WHERE n >= 80)",
    "j6_unseen_values": "SELECT DISTINCT surface AS value FROM matches WHERE surface IS NOT NULL AND surface NOT IN ('Clay', 'Grass', 'Hard')",
    "j7_value_mapping": "SELECT match_num, CASE surface WHEN 'Clay' THEN 0 WHEN 'Grass' THEN 1 WHEN 'Hard' THEN 2 ELSE 3 END AS code FROM matches",
    "j8_median_broadcast": "SELECT match_num, round(coalesce(player1_age, (SELECT median(player1_age) FROM pr)), 6) AS player1_age FROM pr",
    "j9_upsert_players": "SELECT player, matches, wins FROM tot UNION ALL SELECT x, 0, 0 FROM (VALUES ('P7'), ('Nobody')) AS t(x) WHERE x NOT IN (SELECT player FROM tot)",
    "j10_encoder_apply": "SELECT match_num, dense_rank() OVER (ORDER BY coalesce(winner_hand, 'nan')) - 1 AS code FROM matches",
    "j11_serving_pair": "SELECT a.player AS player1, b.player AS player2, a.latest_rank AS p1_rank, b.latest_rank AS p2_rank FROM lat a, lat b WHERE a.player = 'P7' AND b.player = 'P8'",
    "g0_events": "SELECT rn, match_num, player, opponent, hand, opp_hand, rank, ht, seed, age, surface, tourney_id, won FROM e",
    "g1_player_totals": f"SELECT player, matches, wins, {r('win_pct')} FROM tot",
    "g2_surface_totals": "SELECT player, surface, count(*) AS matches, cast(sum(won) AS BIGINT) AS wins FROM s GROUP BY player, surface",
    "g2_surface_map": "SELECT player, surface, matches, cast(wins AS BIGINT) AS wins FROM grid",
    "g3_head_to_head": "SELECT player, opponent, matches, cast(wins AS BIGINT) AS wins FROM h2h",
    "g4_versus_hands": "SELECT * FROM vs",
    "g5_tournaments": "SELECT player, tourney_id, count(*) AS matches, cast(sum(won) AS BIGINT) AS wins FROM s GROUP BY player, tourney_id",
    "g6_histories": "SELECT player, row_number() OVER (PARTITION BY player ORDER BY rn) - 1 AS i, rank, ht, hand, seed, age FROM s",
    "g7_latest": "SELECT player, latest_rank, latest_ht, latest_hand, latest_seed, latest_age FROM lat",
    "g8_win_pct": f"SELECT player, {r('win_pct')} FROM tot",
    "g9_surface_pct": f"SELECT player, surface, round(CASE WHEN matches > 0 THEN wins / matches ELSE 0 END, 6) AS pct FROM grid",
    "g10_hand_pct": "SELECT player, round(CASE WHEN matches_vs_right > 0 THEN wins_vs_right / matches_vs_right ELSE 0 END, 6) AS pct_vs_right, round(CASE WHEN matches_vs_left > 0 THEN wins_vs_left / matches_vs_left ELSE 0 END, 6) AS pct_vs_left FROM vs",
    "g11_tournament_pct": "SELECT player, tourney_id, round(sum(won) / count(*), 6) AS pct FROM s GROUP BY player, tourney_id",
    "g12_preferred_surface": "SELECT * FROM pref",
    "g13_value_counts": "SELECT surface, count(*) AS n FROM matches WHERE surface IS NOT NULL GROUP BY surface",
    "g14_median": "SELECT round(median(winner_rank), 6) AS winner_rank, round(median(winner_age), 6) AS winner_age FROM matches",
    "g15_mean_std": "SELECT round(avg(winner_rank), 6) AS mean, round(stddev_pop(winner_rank), 6) AS std FROM matches",
    "g16_distinct": "SELECT DISTINCT surface FROM matches",
    "g17_count": "SELECT count(*) AS n FROM matches",
    "g18_window_mean": f"SELECT l5.player, {r('last_5')}, {r('last_10')} FROM l5 JOIN l10 ON l5.player = l10.player",
    "g18_window_sums": "SELECT player, rn, cast(sum(won) OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS won_5, count(rank) OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ranked_10 FROM e",
    "g19_metrics": """, c AS (SELECT result AS l, CASE WHEN coalesce(player1_rank, 999) <= coalesce(player2_rank, 999) THEN 1 ELSE 2 END AS p FROM pr),
      k AS (SELECT x.c, count(CASE WHEN l = x.c THEN 1 END) AS sup, count(CASE WHEN p = x.c THEN 1 END) AS cal, count(CASE WHEN l = x.c AND p = x.c THEN 1 END) AS hit FROM c, (VALUES (1), (2)) AS x(c) GROUP BY x.c),
      q AS (SELECT sup, hit, CASE WHEN cal > 0 THEN hit / cal ELSE 0 END AS pre, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS rec FROM k)
      SELECT round(sum(hit) / sum(sup), 6) AS accuracy, round(sum(pre * sup) / sum(sup), 6) AS weighted_precision, round(sum(rec * sup) / sum(sup), 6) AS weighted_recall, round(sum(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END * sup) / sum(sup), 6) AS weighted_f1 FROM q""",
    "w1_last_n": f"SELECT l5.player, {r('last_5')}, {r('last_10')} FROM l5 JOIN l10 ON l5.player = l10.player",
    "w1_running_last_n": "SELECT player, rn, round(avg(won) OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS last_5, round(avg(won) OVER (PARTITION BY player ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS last_10 FROM e",
    "w2_surface_last_10": f"SELECT player, surface, {r('rate')} FROM sl",
    "w3_streaks": "SELECT * FROM strk",
    "w4_running_totals": """, g AS (SELECT *, sum(1 - won) OVER (PARTITION BY player ORDER BY rn) AS li, sum(won) OVER (PARTITION BY player ORDER BY rn) AS wi FROM e)
      SELECT player, rn, count(*) OVER (PARTITION BY player ORDER BY rn) AS matches, cast(wi AS BIGINT) AS wins, cast(CASE WHEN won = 1 THEN sum(won) OVER (PARTITION BY player, li ORDER BY rn) ELSE 0 END AS BIGINT) AS win_streak, cast(CASE WHEN won = 0 THEN sum(1 - won) OVER (PARTITION BY player, wi ORDER BY rn) ELSE 0 END AS BIGINT) AS loss_streak FROM g""",
    "w5_ordinal": "SELECT match_num, rn FROM m",
    "w6_category_code": "SELECT match_num, cast(dense_rank() OVER (ORDER BY winner_name) - 1 AS INT) AS code FROM matches",
    "o1_sort_by_date": "SELECT match_num, tourney_date FROM matches ORDER BY tourney_date, match_num",
    "o2_index_reset": "SELECT match_num, rn FROM m",
    "o2_index_reset_split": "SELECT match_num, row_number() OVER (ORDER BY tourney_date, match_num) - 1 AS rn, count(*) OVER () AS n FROM m WHERE split = 'next'",
    "o3_splits": "SELECT split, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn FROM m GROUP BY split",
    "o4_sort_desc": "SELECT player, wins FROM tot ORDER BY wins DESC, player",
    "o5_top_k": "SELECT player, wins FROM tot ORDER BY wins DESC, player LIMIT 10",
    "o6_holdout": f"SELECT match_num, row_number() OVER (ORDER BY {_H}, match_num) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM pr",
    "o7_resplit": "SELECT split, count(*) AS n FROM m WHERE split <> 'initial' GROUP BY split",
    "u1_union_all": "SELECT match_num, winner_name AS player, loser_name AS other FROM matches UNION ALL SELECT match_num, loser_name, NULL FROM matches",
    "u2_union_distinct": "SELECT winner_name AS player FROM matches UNION SELECT loser_name FROM matches",
    "u3_except": "SELECT DISTINCT surface FROM matches WHERE surface NOT IN ('Hard', 'Clay', 'Grass')",
    "u4_vocabulary_extension": "SELECT DISTINCT coalesce(surface, 'Unknown') AS surface FROM matches UNION SELECT 'Unknown'",
    "f1_parse_date": "SELECT match_num, tourney_date FROM matches",
    "f2_differences": f"SELECT match_num, {', '.join(_DIFF)} FROM df",
    "f3_log_gap": f"SELECT match_num, {r('log_rank_diff')} FROM df",
    "f4_lenient_number": "SELECT match_num, try_cast(winner_seed AS DOUBLE) AS seed FROM matches",
    "f5_constant_fill": "SELECT match_num, player1_hand, player2_hand, player1_rank, player2_rank, player1_seed, player2_seed, surface_encoded FROM fl",
    "f6_median_fill": f"SELECT match_num, {', '.join(r(c) for c in _MED)} FROM fl",
    "f7_surface_normaliser": "SELECT match_num, raw, CASE WHEN raw IN ('Hard', 'hard', 'HARD') THEN 'Hard' WHEN raw IN ('Clay', 'clay', 'CLAY') THEN 'Clay' WHEN raw IN ('Grass', 'grass', 'GRASS') THEN 'Grass' ELSE 'Unknown' END AS surface FROM (SELECT match_num, CASE match_num % 4 WHEN 0 THEN upper(surface) WHEN 1 THEN lower(surface) WHEN 2 THEN surface ELSE lower(surface[1]) || upper(surface[2:]) END AS raw FROM matches)",
    "f8_surface_codes": "SELECT match_num, cast(match_num % 6 AS INT) AS code, CASE match_num % 6 WHEN 0 THEN 'Clay' WHEN 1 THEN 'Grass' WHEN 2 THEN 'Hard' ELSE 'Unknown' END AS surface FROM matches",
    "f9_casts": "SELECT match_num, cast(player1_rank <= 10 AS INT) AS top, coalesce(player1_hand, 'nan') AS hand FROM pr",
    "f10_rank_band": "SELECT match_num, top_10_vs_not FROM df",
    "f11_age_band": "SELECT match_num, young_vs_old FROM df",
    "f12_seed_xor": "SELECT match_num, seeded_vs_unseeded FROM df",
    "f13_height_band": "SELECT match_num, tall_vs_short FROM df",
    "f14_hands": "SELECT match_num, same_hand, left_vs_right FROM df",
    "f15_surface_match": "SELECT match_num, player1_surface_match, player2_surface_match, surface_preference_diff FROM fx",
    "f16_is_top_10": "SELECT match_num, coalesce(winner_rank <> 0 AND winner_rank <= 10, false) AS is_top_10 FROM matches",
    "f17_list_tail": "SELECT player, count(*) AS n, cast(sum(won) AS BIGINT) AS wins FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY rn DESC) AS k FROM s) WHERE k <= 5 GROUP BY player",
    "f18_map_default": "SELECT player, cast(wins AS BIGINT) AS wins_hard, 0::BIGINT AS wins_ice FROM grid WHERE surface = 'Hard'",
    "f19_two_decimals": "SELECT player, ((200 * wins + matches) // (2 * matches)) / 100 AS shown FROM tot",
    "f19_two_decimals_whole": "SELECT player, ((200 * wins + matches) // (2 * matches)) / 100 AS shown FROM tot",
    "f20_seeded_coin": "SELECT match_num, swap FROM sw",
    "f21_or_unranked": "SELECT match_num, coalesce(nullif(try_cast(winner_seed AS DOUBLE), 0), 999) AS seed FROM matches",
    "f23_required": "SELECT match_num, winner_name FROM matches",
    "f22_z_score": "SELECT match_num, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM fl)) / (SELECT stddev_pop({c}) FROM fl), 6) AS {c}" for c in _SCALED) + " FROM fl",
    "m1_label_encoder": "SELECT value, cast(row_number() OVER (ORDER BY value) - 1 AS INT) AS code FROM (SELECT DISTINCT coalesce(player1_hand, 'nan') AS value FROM pr)",
    "m2_median_imputer": "SELECT match_num, round(coalesce(winner_rank, (SELECT median(winner_rank) FROM m WHERE split = 'next')), 6) AS winner_rank, round(coalesce(winner_ht, (SELECT median(winner_ht) FROM m WHERE split = 'next')), 6) AS winner_ht FROM m WHERE split = 'final'",
    "m3_standard_scaler": "SELECT match_num, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM fl)) / (SELECT stddev_pop({c}) FROM fl), 6) AS {c}" for c in _SCALED) + " FROM fl",
    "m6_metrics": """, c AS (SELECT CASE WHEN surface IN ('Hard', 'Clay', 'Grass', 'Carpet') THEN surface ELSE 'Unknown' END AS surface, match_num % 3 AS l, (match_num * 7 + length(winner_name)) % 3 AS p FROM matches),
      k AS (SELECT surface, x.c, count(CASE WHEN l = x.c THEN 1 END) AS sup, count(CASE WHEN p = x.c THEN 1 END) AS cal, count(CASE WHEN l = x.c AND p = x.c THEN 1 END) AS hit FROM c, (VALUES (0), (1), (2)) AS x(c) GROUP BY surface, x.c),
      q AS (SELECT surface, sup, hit, CASE WHEN cal > 0 THEN hit / cal ELSE 0 END AS pre, CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS rec FROM k)
      SELECT surface, round(sum(hit) / sum(sup), 6) AS accuracy, round(sum(pre * sup) / sum(sup), 6) AS weighted_precision, round(sum(rec * sup) / sum(sup), 6) AS weighted_recall, round(sum(CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END * sup) / sum(sup), 6) AS weighted_f1 FROM q GROUP BY surface""",
    "m3_scaler_parameters": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM df" for c in ("rank_diff", "player2_age")),
    "m8_numeric_coercion": "SELECT match_num, try_cast(winner_seed AS DOUBLE) AS winner_seed, try_cast(loser_seed AS DOUBLE) AS loser_seed, cast(winner_rank AS DOUBLE) AS winner_rank FROM matches",
    "m9_serving_features": """, q AS (SELECT a.player AS player1, b.player AS player2, 'Clay' AS surface, a.latest_rank AS r1, b.latest_rank AS r2, a.latest_age AS a1, b.latest_age AS a2, a.latest_seed AS s1, b.latest_seed AS s2, a.latest_ht AS h1, b.latest_ht AS h2 FROM lat a, lat b WHERE cast(substr(a.player, 2) AS INT) + 1 = cast(substr(b.player, 2) AS INT)),
      p1 AS (SELECT player, preferred_surface = 'Clay' AS at_home FROM pref)
      SELECT player1, player2, r1 - r2 AS rank_diff, round(ln(1 + abs(r1 - r2)), 6) AS log_rank_diff, coalesce(r1 <= 10, false) AND NOT coalesce(r2 <= 10, false) AS top_10_vs_not, a1 - a2 AS age_diff, coalesce(a1 < a2, false) AS young_vs_old,
      coalesce(try_cast(s1 AS DOUBLE), 999) - coalesce(try_cast(s2 AS DOUBLE), 999) AS seed_diff, s1 IS NOT NULL AND s2 IS NULL AS seeded_vs_unseeded, h1 - h2 AS height_diff, coalesce(h1 > h2, false) AS tall_vs_short,
      round(a5.last_5, 6) AS player1_last_5_win_percentage, round(b5.last_5, 6) AS player2_last_5_win_percentage, round(a10.last_10, 6) AS player1_last_10_win_percentage, round(b10.last_10, 6) AS player2_last_10_win_percentage,
      round(coalesce(asl.rate, 0), 6) AS player1_surface_last_10_win_percentage, round(coalesce(bsl.rate, 0), 6) AS player2_surface_last_10_win_percentage,
      cast(ah_.at_home AS INT) AS player1_preferred_surface, cast(bh_.at_home AS INT) AS player2_preferred_surface, cast(ah_.at_home AS INT) AS player1_surface_match, cast(bh_.at_home AS INT) AS player2_surface_match, cast(ah_.at_home AS INT) - cast(bh_.at_home AS INT) AS surface_preference_diff,
      cast(coalesce(ah.wins, 0) AS BIGINT) AS head_to_head_wins_p1, cast(coalesce(bh.wins, 0) AS BIGINT) AS head_to_head_wins_p2, 0 AS surface, 0 AS surface_encoded
      FROM q JOIN l5 a5 ON a5.player = player1 JOIN l5 b5 ON b5.player = player2 JOIN l10 a10 ON a10.player = player1 JOIN l10 b10 ON b10.player = player2 LEFT JOIN sl asl ON asl.player = player1 AND asl.surface = q.surface LEFT JOIN sl bsl ON bsl.player = player2 AND bsl.surface = q.surface
      JOIN p1 ah_ ON ah_.player = player1 JOIN p1 bh_ ON bh_.player = player2 LEFT JOIN h2h ah ON ah.player = player1 AND ah.opponent = player2 LEFT JOIN h2h bh ON bh.player = player2 AND bh.opponent = player1""",
    "m4_first_splits": f""", x AS (SELECT match_num, coalesce(player1_rank, 999) <= 10 OR coalesce(player2_rank, 999) <= 10 AS is_top, cast(result = 1 AS INT) AS y, {', '.join(_NUMBERS.get(c, f'cast({c} AS DOUBLE)') + ' AS ' + c for c in FEATURES)} FROM pinx),
      sh AS (SELECT is_top, avg(y) AS share FROM x GROUP BY is_top),
      l AS (SELECT is_top, y, unnest([{', '.join(f"'{c}'" for c in FEATURES)}]) AS feature, unnest([{', '.join(FEATURES)}]) AS v FROM x),
      q AS (SELECT l.is_top, feature, v, cast(round((share - y) * 16777216) AS BIGINT) AS g, cast(round(share * (1 - share) * 16777216) AS BIGINT) AS h FROM l JOIN sh ON sh.is_top = l.is_top),
      b AS (SELECT is_top, feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM q GROUP BY ALL),
      c AS (SELECT *, sum(CASE WHEN v IS NOT NULL THEN g END) OVER w AS gu, sum(CASE WHEN v IS NOT NULL THEN h END) OVER w AS hu, sum(CASE WHEN v IS NOT NULL THEN n END) OVER w AS nu, sum(g) OVER o AS ga, sum(h) OVER o AS ha, sum(n) OVER o AS na,
        coalesce(sum(CASE WHEN v IS NULL THEN g END) OVER o, 0) AS gm, coalesce(sum(CASE WHEN v IS NULL THEN h END) OVER o, 0) AS hm, coalesce(sum(CASE WHEN v IS NULL THEN n END) OVER o, 0) AS nm
        FROM b WINDOW w AS (PARTITION BY is_top, feature ORDER BY v NULLS FIRST), o AS (PARTITION BY is_top, feature)),
      t AS (SELECT is_top, feature, v, missing_left, gu + missing_left * gm AS gl, hu + missing_left * hm AS hl, nu + missing_left * nm AS nl, ga, ha, na FROM c, (VALUES (0), (1)) AS z(missing_left) WHERE v IS NOT NULL),
      s2 AS (SELECT *, round(pow(gl / 16777216, 2) / (hl / 16777216) + pow((ga - gl) / 16777216, 2) / ((ha - hl) / 16777216) - pow(ga / 16777216, 2) / (ha / 16777216), 9) AS gain FROM t WHERE nl >= 20 AND na - nl >= 20)
      SELECT is_top, feature, round(gain, 6) AS gain, coalesce((v + next_v) / 2, 'inf'::DOUBLE) AS upto, missing_left = 1 AS missing_left, cast(nl AS BIGINT) AS n_left
      FROM s2 JOIN (SELECT feature, v, lead(v) OVER (PARTITION BY feature ORDER BY v) AS next_v FROM (SELECT DISTINCT feature, v FROM b WHERE v IS NOT NULL)) nv USING (feature, v) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY is_top, feature ORDER BY gain DESC, v, missing_left) = 1""",
    "m7_permuted_accuracy": """, x AS (SELECT match_num, surface, result, rank_diff AS a, age_diff AS b, height_diff AS c, substr(md5(concat(cast(match_num AS VARCHAR), ':42:block')), 1, 1) AS k FROM df),
      p AS (SELECT *, """
    + ", ".join(f"coalesce(lead({{'v': {c}}}) OVER (PARTITION BY k ORDER BY md5(concat(cast(match_num AS VARCHAR), ':42:{f}')), match_num), first({{'v': {c}}}) OVER (PARTITION BY k ORDER BY md5(concat(cast(match_num AS VARCHAR), ':42:{f}')), match_num)).v AS p{c}" for c, f in (("a", "rank_diff"), ("b", "age_diff"), ("c", "height_diff")))
    + """ FROM x), r AS (SELECT surface, """
    + ", ".join(f"avg(cast((coalesce(-{x}, 0) + 3 * coalesce(-{y}, 0) + coalesce({z}, 0) > 0) = (result = 1) AS INT)) AS {n}" for n, x, y, z in (("r", "a", "b", "c"), ("ra", "pa", "b", "c"), ("rb", "a", "pb", "c"), ("rc", "a", "b", "pc")))
    + """ FROM p GROUP BY surface)
      SELECT surface, feature, round(r, 6) AS accuracy, round(q, 6) AS permuted_accuracy, round(r - q, 6) AS importance FROM (SELECT surface, 'rank_diff' AS feature, r, ra AS q FROM r UNION ALL SELECT surface, 'age_diff', r, rb FROM r UNION ALL SELECT surface, 'height_diff', r, rc FROM r)""",
    "m11_player_profile": f"SELECT tot.player, {', '.join(f'(SELECT round(CASE WHEN matches > 0 THEN wins / matches ELSE 0 END, 6) FROM grid WHERE grid.player = tot.player AND surface = {chr(39)}{x}{chr(39)}) AS pct_{x.lower()}' for x in ('Hard', 'Clay', 'Grass'))}, {r('win_pct')}, {r('last_5')}, win_streak, loss_streak, preferred_surface FROM tot JOIN l5 ON l5.player = tot.player JOIN strk ON strk.player = tot.player JOIN pref ON pref.player = tot.player WHERE tot.player = 'P7'",
    "x_state_snapshot": f"SELECT tot.player, matches, wins, {r('win_pct')}, {r('last_5')}, {r('last_10')}, win_streak, loss_streak, preferred_surface, matches_vs_right, wins_vs_right, matches_vs_left, wins_vs_left, latest_rank, latest_ht, latest_hand, latest_seed, latest_age FROM tot JOIN l5 ON l5.player = tot.player JOIN l10 ON l10.player = tot.player JOIN strk ON strk.player = tot.player JOIN pref ON pref.player = tot.player JOIN vs ON vs.player = tot.player JOIN lat ON lat.player = tot.player",
    "x_pair_features_snapshot": f"SELECT {_pick([*FEATURE_COLUMNS, *LOOKED_UP])} FROM fx",
    "x_filled_features": f"SELECT {_pick([*FEATURE_COLUMNS, *LOOKED_UP, 'player1_rank', 'player2_rank', 'player1_seed', 'player1_hand', 'player1_age', 'player2_ht'])} FROM fl",
    "e1_before_match": "SELECT pit.player, pit.rn, round(last_5, 6) AS last_5, round(last_10, 6) AS last_10, round(surface_last_10, 6) AS surface_last_10, h2h_wins, preferred_surface FROM pit JOIN pitp ON pitp.player = pit.player AND pitp.rn = pit.rn",
    "e1_pair_features_point_in_time": f"SELECT {_pick([*FEATURE_COLUMNS, *LOOKED_UP])} FROM pinx",
    "e2_streaming_state": f"SELECT tot.player, matches, wins, {r('last_5')}, {r('last_10')}, win_streak, loss_streak, preferred_surface, matches_vs_right, wins_vs_right, matches_vs_left, wins_vs_left, latest_rank, latest_ht, latest_hand, latest_seed, latest_age FROM tot JOIN l5 ON l5.player = tot.player JOIN l10 ON l10.player = tot.player JOIN strk ON strk.player = tot.player JOIN pref ON pref.player = tot.player JOIN vs ON vs.player = tot.player JOIN lat ON lat.player = tot.player",
    "e2_streaming_tallies": """SELECT player, 'opponents' AS of, opponent AS name, count(*) AS matches, cast(sum(won) AS BIGINT) AS wins, cast(NULL AS DOUBLE) AS rate FROM e GROUP BY player, opponent
      UNION ALL SELECT player, 'tournaments', tourney_id, count(*), cast(sum(won) AS BIGINT), NULL FROM e GROUP BY player, tourney_id UNION ALL SELECT player, 'surfaces', surface, NULL, NULL, round(rate, 6) FROM sl""",
}

#: Queries over the whole split that are also registered as NAME_whole.
WHOLE_SPLIT = """p2_side_swap p3_result_label p9_projection p14_either_side p15_segment_routing j2_form_lookup j3_head_to_head_lookup j4_surface_form_lookup j8_median_broadcast g19_metrics o6_holdout
    f2_differences f3_log_gap f5_constant_fill f6_median_fill f9_casts f10_rank_band f11_age_band f12_seed_xor f13_height_band f14_hands f15_surface_match f20_seeded_coin f22_z_score m1_label_encoder m3_standard_scaler
    x_pair_features_snapshot x_filled_features e1_pair_features_point_in_time""".split()


SQL |= {"p13_point_lookup_kept": SQL["p13_point_lookup"], "j11_serving_pair_kept": SQL["j11_serving_pair"], "x_state_kept": SQL["x_state_snapshot"], "e2_streaming_late": SQL["e2_streaming_state"]}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, tail, ctes in [*((k, v, _AFTER_ALL if k.startswith("e2_") else _SELECTIVE if k == "p6_min_matches" else _CTES) for k, v in SQL.items()), *((f"{k}_whole", SQL[k], _CTES) for k in WHOLE_SPLIT)]:
        if tail.startswith(", "):  # has definitions of its own after the shared ones
            full = _with(tail, ctes)
            head, own = full[: -len(tail)].rstrip(), tail
            out[k] = head + own
        else:
            out[k] = _with(tail, ctes)
    return out
