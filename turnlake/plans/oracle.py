"""The same queries in SQL, written for a single-node engine to check the Spark results.

Rates here are averages over rows, and windows run over whole matches, so the SQL shares
neither the totals nor the blocks of the Spark plans.
"""

from __future__ import annotations

from turnlake.schemas import AGENT_META, AGENTS, PAYOFFS, STAGING_COLUMNS, TURNS


def _literal(value: str | int | None) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)


_NUMBERED_AGENTS = [(i, *AGENT_META[i][:2]) for i in range(len(AGENTS))]

_TABLES = f"""
seed(agent_name, agent_type, description, coded_equivalent, equivalence) AS (
  VALUES {_values(AGENT_META)}),
agent(idx, name, kind) AS (VALUES {_values(_NUMBERED_AGENTS)}),
payoffs(move, opponent_move, payoff, opponent_payoff) AS (VALUES {_values(PAYOFFS)})"""

_BRONZE = """
ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
usr AS (
  SELECT user_id, least(user_id % 8, (user_id // 8) % 8) AS ia,
         greatest(user_id % 8, (user_id // 8) % 8) AS ib, count(*) // 2 AS n_turns
  FROM ev GROUP BY user_id HAVING count(*) >= 2),
game AS (
  SELECT u.*, a.name || '__vs__' || b.name || '__t' || n_turns || '__r' || repeat AS match_id
  FROM (SELECT *, dense_rank() OVER (PARTITION BY ia, ib ORDER BY user_id) AS repeat
        FROM usr) u
  JOIN agent a ON a.idx = ia JOIN agent b ON b.idx = ib),
meant AS (
  SELECT g.*, e.ts, e.event_id, e.value, (e.rn + 1) // 2 AS turn, g.ia AS own, g.ib AS other,
         'A' AS seat, e.event_type
  FROM ev e JOIN game g USING (user_id) WHERE e.rn % 2 = 1 AND (e.rn + 1) // 2 <= n_turns
  UNION ALL
  SELECT g.*, e.ts, e.event_id, e.value, e.rn // 2, g.ib, g.ia, 'B', e.event_type
  FROM ev e JOIN game g USING (user_id) WHERE e.rn % 2 = 0),
intent AS (
  SELECT m.*, p.name AS player, p.kind AS player_type, o.name AS opponent,
         o.kind AS opponent_type, event_id % 10 AS shape,
         CASE WHEN own = 0 THEN 'C' WHEN own = 1 THEN 'D'
              WHEN event_type IN ('view', 'click', 'purchase') THEN 'C' ELSE 'D' END AS wish
  FROM meant m JOIN agent p ON p.idx = own JOIN agent o ON o.idx = other),
decision AS (
  SELECT *, player_type = 'coded' OR shape < 8 AS is_parsable,
         CASE WHEN player_type = 'coded' OR shape < 8 THEN wish ELSE 'C' END AS move,
         CASE WHEN player_type = 'llm' THEN value END AS response_time,
         CASE WHEN player_type = 'coded' THEN NULL
              WHEN shape <= 4 THEN '{"move": "' || wish || '"}'
              WHEN shape = 5 THEN '{"move": "' ||
                CASE wish WHEN 'C' THEN 'cooperate' ELSE 'defect' END ||
                '", "justification": "ok"}'
              WHEN shape = 6 THEN 'Mon choix : ' || wish
              WHEN shape = 7 THEN 'Je vais ' ||
                CASE wish WHEN 'C' THEN 'coopérer' ELSE 'trahir' END
              WHEN shape = 8 THEN 'coopérer ou trahir'
              ELSE '{"move": "X"}' END AS raw_output
  FROM intent),
bronze AS (
  SELECT d.match_id, d.seat, CAST(d.repeat AS INT) AS repeat, CAST(d.turn AS INT) AS turn,
         CAST(d.n_turns AS INT) AS n_turns, d.player, d.player_type, d.opponent,
         d.opponent_type, d.move, x.move AS opponent_move, p.payoff, p.opponent_payoff,
         d.response_time, d.raw_output, d.is_parsable, 'fixture' AS run_id,
         strftime(CASE d.seat WHEN 'A' THEN d.ts ELSE x.ts END,
                  '%Y-%m-%dT%H:%M:%S+00:00') AS played_at
  FROM decision d
  JOIN decision x ON x.user_id = d.user_id AND x.turn = d.turn AND x.seat <> d.seat
  JOIN payoffs p ON p.move = d.move AND p.opponent_move = x.move)"""

_SILVER = """
ordered AS (
  SELECT *, lag(opponent_move) OVER w AS opponent_last_move, row_number() OVER w AS pos,
         CAST(sum(payoff) OVER w AS BIGINT) AS own_cum_score,
         CAST(sum(opponent_payoff) OVER w AS BIGINT) AS opp_cum_score,
         count(*) FILTER (move = 'C') OVER w / CAST(turn AS DOUBLE) AS own_coop_rate,
         count(*) FILTER (opponent_move = 'C') OVER w / CAST(turn AS DOUBLE)
           AS opp_coop_rate
  FROM bronze WINDOW w AS (PARTITION BY match_id, seat ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
silver AS (
  SELECT * EXCLUDE (pos),
         CAST(pos - 1 - coalesce(max(pos) FILTER (opponent_move <> 'D') OVER (
           PARTITION BY match_id, seat ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT)
           AS opponent_defection_streak,
         coalesce(opponent_last_move = 'D', false) AND move = 'C' AS forgave_this_turn,
         coalesce(opponent_last_move = 'D', false) AND move = 'D' AS retaliated_this_turn,
         CASE move || opponent_move WHEN 'CC' THEN 'mutual_coop' WHEN 'DD' THEN
           'mutual_defect' WHEN 'CD' THEN 'exploited' ELSE 'exploiter' END AS round_outcome
  FROM ordered)"""

_GOLD = f"""
stg AS (SELECT {", ".join(STAGING_COLUMNS)} FROM silver),
dim AS (
  SELECT u.agent_name, s.* EXCLUDE (agent_name)
  FROM (SELECT DISTINCT player AS agent_name FROM stg) u LEFT JOIN seed s USING (agent_name)),
fact AS (
  SELECT md5(coalesce(CAST(match_id AS VARCHAR), '_null_') || '-' ||
             coalesce(CAST(turn AS VARCHAR), '_null_') || '-' ||
             coalesce(CAST(seat AS VARCHAR), '_null_')) AS turn_key, stg.*,
         dim.coded_equivalent AS player_coded_equivalent,
         dim.equivalence AS player_equivalence
  FROM stg LEFT JOIN dim ON stg.player = dim.agent_name),
replay AS (
  SELECT *, coalesce(max(CAST(opponent_move = 'D' AS INT)) OVER (
           PARTITION BY match_id, seat ORDER BY turn
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opp_defected_before
  FROM fact WHERE player_type = 'llm'),
expected AS (
  SELECT replay.*, CASE memory WHEN 'none' THEN opening
           WHEN 'last' THEN CASE turn WHEN 1 THEN opening ELSE opponent_last_move END
           WHEN 'all' THEN if(opp_defected_before > 0, 'D', opening) END AS expected_move
  FROM replay LEFT JOIN (VALUES ('always_cooperate', 'C', 'none'), ('always_defect', 'D', 'none'),
    ('tit_for_tat', 'C', 'last'), ('grim_trigger', 'C', 'all')) rules(rule, opening, memory)
    ON rule = player_coded_equivalent),
board AS (
  SELECT f.player AS agent, d.agent_type, count(*) AS n_turns_joues,
         count(DISTINCT match_id) AS n_matches, avg(payoff) AS score_moyen_par_tour,
         CAST(sum(payoff) AS BIGINT) AS score_total,
         avg(CAST(move = 'C' AS INT)) AS taux_cooperation,
         avg(CAST(forgave_this_turn AS INT)) FILTER (opponent_last_move = 'D')
           AS taux_pardon,
         avg(CAST(retaliated_this_turn AS INT)) FILTER (opponent_last_move = 'D')
           AS taux_riposte,
         round(avg(response_time), 9) AS temps_moyen_reponse_s
  FROM fact f LEFT JOIN dim d ON d.agent_name = f.player GROUP BY ALL),
matchup AS (
  SELECT player, opponent, count(DISTINCT match_id) AS n_matches,
         avg(payoff) AS score_moyen_par_tour, avg(CAST(move = 'C' AS INT)) AS taux_cooperation
  FROM fact GROUP BY ALL),
overtime AS (
  SELECT player AS agent, player_type AS agent_type, turn,
         avg(CAST(move = 'C' AS INT)) AS taux_cooperation, avg(payoff) AS score_moyen
  FROM fact GROUP BY ALL),
versus AS (
  SELECT l.agent AS persona, d.coded_equivalent,
         l.score_moyen_par_tour AS score_moyen_persona,
         c.score_moyen_par_tour AS score_moyen_code,
         l.taux_cooperation AS coop_persona, c.taux_cooperation AS coop_code,
         l.taux_pardon AS pardon_persona, c.taux_pardon AS pardon_code,
         l.taux_riposte AS riposte_persona, c.taux_riposte AS riposte_code,
         l.temps_moyen_reponse_s
  FROM board l JOIN dim d ON d.agent_name = l.agent AND d.agent_type = 'llm'
  LEFT JOIN board c ON c.agent = d.coded_equivalent),
fidelity AS (
  SELECT player AS persona, player_coded_equivalent AS coded_equivalent,
         player_equivalence AS equivalence, count(*) AS n_tours,
         count(expected_move) AS n_tours_evaluables,
         avg(CAST(move = expected_move AS INT)) AS fidelite,
         avg(CAST(move = 'D' AS INT)) FILTER (expected_move = 'D')
           AS riposte_attendue_respectee,
         avg(CAST(move = 'C' AS INT)) FILTER (expected_move = 'C')
           AS cooperation_attendue_respectee,
         avg(CAST(is_parsable AS INT)) AS taux_parsable
  FROM expected GROUP BY ALL),
fidelity_opp AS (
  SELECT player AS persona, opponent, count(*) AS n_tours,
         avg(CAST(move = expected_move AS INT)) AS fidelite
  FROM expected GROUP BY ALL),
pairs AS (
  SELECT player AS agent, player_type AS agent_type, count(*) AS n,
         count(*) FILTER (move = 'C') AS x, count(*) FILTER (opponent_last_move = 'C') AS y,
         count(*) FILTER (move = 'C' AND opponent_last_move = 'C') AS xy,
         avg(payoff) AS score
  FROM fact WHERE opponent_last_move IS NOT NULL GROUP BY ALL),
recip AS (
  SELECT agent, agent_type, n AS n_tours,
         CAST(CAST(n AS HUGEINT) * xy - CAST(x AS HUGEINT) * y AS DOUBLE) / nullif(sqrt(
           CAST(x AS DOUBLE) * CAST(n - x AS DOUBLE) * CAST(y AS DOUBLE)
           * CAST(n - y AS DOUBLE)), 0) AS reciprocite,
         score AS score_moyen_par_tour, CAST(x AS DOUBLE) / n AS taux_cooperation
  FROM pairs)"""

_PARSED = r"""
answer AS (
  SELECT match_id, turn, seat, player, raw_output AS raw FROM bronze
  WHERE raw_output IS NOT NULL),
payload AS (
  SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS obj
  FROM answer),
fields AS (
  SELECT *, json_type(obj, '$.move') AS move_type, json_type(obj, '$.justification') AS why_type,
         json_extract_string(obj, '$.move') AS move_text,
         json_extract_string(obj, '$.justification') AS why_text
  FROM payload),
stages AS (
  SELECT *,
    CASE WHEN move_type = 'VARCHAR'
         THEN nullif(regexp_extract(upper(trim(move_text)), '^[CD]'), '') END AS json_move,
    nullif(regexp_extract(upper(raw), '\b([CD])\b', 1), '') AS letter_move,
    CASE WHEN regexp_matches(raw, '(?i)coop[ée]r') AND NOT regexp_matches(raw, '(?i)trah')
         THEN 'C'
         WHEN regexp_matches(raw, '(?i)trah') AND NOT regexp_matches(raw, '(?i)coop[ée]r')
         THEN 'D' END AS keyword_move
  FROM fields)"""

_LAYERS = [_TABLES, _BRONZE, _SILVER, _GOLD, _PARSED]


def _sql(select: str) -> str:
    return "WITH" + ",".join(_LAYERS) + "\n" + select.strip()


_KEY = "match_id, turn, seat"
_PER_MATCH = """SELECT match_id, count(*) AS n_rows, CAST(sum(payoff) AS BIGINT) AS payoff
  FROM bronze GROUP BY match_id"""


def _schedule(n_turns: int) -> str:
    return f"""
      SELECT a.agent_name || '__vs__' || b.agent_name || '__t{n_turns}__r' || r AS match_id,
             a.idx AS a_idx, b.idx AS b_idx, a.agent_name AS a_player,
             b.agent_name AS b_player, {n_turns} AS n_turns, CAST(r AS INT) AS repeat
      FROM places a JOIN places b ON a.idx <= b.idx,
           range(1, (SELECT max(repeat) FROM bronze) + 1) AS reps(r)"""


_PLACES = """places AS (
  SELECT name AS agent_name, row_number() OVER (ORDER BY idx) AS idx
  FROM agent WHERE name IN (SELECT player FROM bronze))"""


def _scheduled(n_turns: int, select: str) -> str:
    layers = [*_LAYERS, "\n" + _PLACES, f"\nscheduled AS ({_schedule(n_turns)})"]
    return "WITH" + ",".join(layers) + "\n" + select.strip()


def _pivot(row: str, column: str, value: str, table: str) -> str:
    cells = ", ".join(f"max({value}) FILTER ({column} = '{a}') AS {a}" for a in AGENTS)
    listed = ", ".join(f"'{a}'" for a in AGENTS)
    others = (
        f"string_agg({column} || '=' || {value}, ', ' ORDER BY {column})"
        f" FILTER ({column} NOT IN ({listed})) AS others"
    )
    n_others = f"count(*) FILTER ({column} NOT IN ({listed})) AS n_others"
    return f"SELECT {row}, {cells}, {others}, {n_others} FROM {table} GROUP BY {row}"


# CRC-32 of ASCII text: the byte table from its polynomial, then one look-up per byte.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t)"""
_CRC = """xor(4294967295, list_reduce(
  list_concat([4294967295],
    list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def _place(mart: str, table: str, row: list[str], order: str) -> str:
    label = " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in row)
    return (
        f"SELECT '{mart}' AS mart, {label} AS row, "
        f"CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place FROM {table}"
    )


def _failures(test: str, model: str, column: str, condition: str, table: str) -> str:
    return (
        f"SELECT '{test}' AS test, '{model}' AS model, '{column}' AS \"column\", "
        f"count(*) FILTER ({condition}) AS failures FROM {table}"
    )


def _duplicates(model: str, column: str, table: str) -> str:
    return _failures(
        "unique",
        model,
        column,
        "n > 1",
        f"(SELECT {column}, count(*) AS n FROM {table} WHERE {column} IS NOT NULL"
        f" GROUP BY {column})",
    )


def _union(*selects: str) -> str:
    return " UNION ALL ".join(selects)


_DQ_NOT_NULL = _union(
    *[
        _failures("not_null", model, column, f"{column} IS NULL", table)
        for model, column, table in [
            ("fct_turns", "turn_key", "fact"),
            ("fct_turns", "player", "fact"),
            ("dim_agent", "agent_name", "dim"),
            ("agg_persona_fidelity", "persona", "fidelity"),
            ("silver.turns", "match_id", "silver"),
            ("silver.turns", "player", "silver"),
        ]
    ]
)
_DQ_UNIQUE = _union(
    _duplicates("fct_turns", "turn_key", "fact"),
    _duplicates("dim_agent", "agent_name", "dim"),
    _duplicates("agg_persona_fidelity", "persona", "fidelity"),
)
_DQ_VALUES = _union(
    _failures("accepted_values", "fct_turns", "move", "move NOT IN ('C', 'D')", "fact"),
    _failures(
        "accepted_values",
        "fct_turns",
        "round_outcome",
        "round_outcome NOT IN ('mutual_coop', 'mutual_defect', 'exploited', 'exploiter')",
        "fact",
    ),
)
_DQ_RELATION = _failures(
    "relationships",
    "fct_turns",
    "player",
    "player IS NOT NULL AND player NOT IN (SELECT agent_name FROM dim)",
    "fact",
)
_DQ_RANGE = _failures(
    "accepted_range",
    "agg_persona_fidelity",
    "fidelite",
    "fidelite < 0 OR fidelite > 1",
    "fidelity",
)

_PHASES = """
  SELECT agent, round(avg(taux_cooperation) FILTER (turn <= 10), 9) AS coop_debut,
         round(avg(taux_cooperation) FILTER (turn > top - 10), 9) AS coop_fin,
         round(avg(taux_cooperation) FILTER (turn > top - 10)
               - avg(taux_cooperation) FILTER (turn <= 10), 9) AS derive
  FROM overtime, (SELECT max(turn) AS top FROM overtime)
  GROUP BY agent HAVING derive IS NOT NULL"""

_REPLAY = """SELECT match_id, seat, player, turn, move, opponent_move, payoff,
    own_cum_score, round_outcome,
    CASE player_type WHEN 'llm' THEN raw_output END AS raw_output
  FROM fact WHERE match_id = (SELECT coalesce(
    min(match_id) FILTER (contains(match_id, 'persona')), min(match_id)) FROM bronze)"""


def oracle_sql(
    schedule_turns: int, schedule_limit: int, shown_agents: list[str], sample_seed: int
) -> dict[str, str]:
    shown = ", ".join(map(_literal, shown_agents))
    log = ", ".join(TURNS.names)
    kept = [c for c in TURNS.names if c not in ("response_time", "raw_output")]
    return {
        "scan_turns": _sql(f"SELECT {log} FROM bronze"),
        "existing_match_ids": _sql("SELECT DISTINCT match_id FROM bronze"),
        "append_relaxed": _sql(
            f"""SELECT {', '.join(kept)},
                  CASE player_type WHEN 'llm' THEN response_time END AS response_time,
                  CASE player_type WHEN 'llm' THEN raw_output END AS raw_output
                FROM bronze"""
        ),
        "incremental_load": _sql(f"SELECT {log} FROM bronze WHERE repeat > 1"),
        "stream_load": _sql(_PER_MATCH),
        "append_after_overwrite": _sql(_PER_MATCH),
        "late_turns": _sql(_PER_MATCH),
        "concurrent_loads": _sql(_PER_MATCH),
        "compacted_log": _sql(_PER_MATCH),
        "rebuild_after_failure": _sql(
            """SELECT match_id, count(*) AS n_rows, CAST(sum(payoff) AS BIGINT) AS payoff,
                 'died' AS state
               FROM bronze WHERE repeat = 1 GROUP BY match_id
               UNION ALL
               SELECT match_id, count(*), CAST(sum(payoff) AS BIGINT), 'rebuilt'
               FROM bronze GROUP BY match_id"""
        ),
        "silver_by_load": _sql("SELECT * FROM silver"),
        "typed_turns": _sql(
            f"""SELECT {_KEY}, CAST(epoch(CAST(substr(played_at, 1, 19) AS TIMESTAMP)) AS BIGINT)
                  AS played_at_s FROM bronze"""
        ),
        "mart_read_back": _sql("SELECT * FROM matchup"),
        "match_sample": "WITH" + ",".join([*_LAYERS, "\n" + _CRC_TABLE]) + f"""
            SELECT match_id, count(*) AS n_rows FROM bronze, crc_table
            WHERE {_CRC.format(text=f"'{sample_seed}:' || match_id")} % 4 < 1
            GROUP BY match_id""",
        "pending_repeats": _scheduled(
            schedule_turns,
            """SELECT * FROM scheduled s WHERE NOT EXISTS (SELECT 1 FROM bronze b
               WHERE b.seat = 'A' AND b.player = s.a_player AND b.opponent = s.b_player
                 AND b.repeat = s.repeat)""",
        ),
        "presented_marts": _sql(
            " UNION ALL ".join(
                [
                    _place("agg_agent_leaderboard", "board", ["agent"],
                           "score_moyen_par_tour DESC NULLS LAST, agent"),
                    _place("agg_matchup_matrix", "matchup", ["player", "opponent"],
                           "player, score_moyen_par_tour DESC NULLS LAST, opponent"),
                    _place("agg_cooperation_over_time", "overtime", ["agent", "agent_type", "turn"],
                           "agent, turn, agent_type"),
                    _place("agg_persona_fidelity", "fidelity", ["persona"],
                           "fidelite DESC NULLS LAST, persona"),
                    _place("agg_persona_fidelity_by_opponent", "fidelity_opp",
                           ["persona", "opponent"], "persona, fidelite NULLS LAST, opponent"),
                    _place("agg_reciprocity", "recip", ["agent", "agent_type"],
                           "reciprocite DESC NULLS LAST, agent, agent_type"),
                ]
            )
        ),
        "match_schedule": _scheduled(schedule_turns, "SELECT * FROM scheduled"),
        "match_schedule_limit": _scheduled(
            schedule_turns,
            f"SELECT * FROM scheduled ORDER BY a_idx, b_idx, repeat LIMIT {schedule_limit}",
        ),
        "pending_matches": _scheduled(
            schedule_turns,
            "SELECT * FROM scheduled WHERE match_id NOT IN (SELECT match_id FROM bronze)",
        ),
        "tidy_seats": _sql(
            """SELECT match_id, repeat, turn, n_turns, run_id, played_at, seat, player,
                      player_type, opponent, opponent_type, move, opponent_move,
                      response_time, raw_output, is_parsable FROM bronze"""
        ),
        "payoff_join": _sql(
            f"SELECT {_KEY}, move, opponent_move, payoff, opponent_payoff FROM bronze"
        ),
        "dq_payoff_matrix": _sql(
            """SELECT t AS temptation, r AS reward, p AS punishment, s AS sucker,
                      lo_t = t AND lo_r = r AND lo_p = p AND lo_s = s AS is_consistent,
                      lo_t = t AND lo_r = r AND lo_p = p AND lo_s = s
                        AND t = 5 AND r = 3 AND p = 1 AND s = 0 AS matches_declared,
                      t > r AND r > p AND p > s AS is_ordered,
                      2 * r > t + s AS beats_alternation
               FROM (SELECT max(payoff) FILTER (move = 'D' AND opponent_move = 'C') AS t,
                            max(payoff) FILTER (move = 'C' AND opponent_move = 'C') AS r,
                            max(payoff) FILTER (move = 'D' AND opponent_move = 'D') AS p,
                            max(payoff) FILTER (move = 'C' AND opponent_move = 'D') AS s,
                            min(payoff) FILTER (move = 'D' AND opponent_move = 'C') AS lo_t,
                            min(payoff) FILTER (move = 'C' AND opponent_move = 'C') AS lo_r,
                            min(payoff) FILTER (move = 'D' AND opponent_move = 'D') AS lo_p,
                            min(payoff) FILTER (move = 'C' AND opponent_move = 'D') AS lo_s
                     FROM bronze)"""
        ),
        "cum_scores": _sql(f"SELECT {_KEY}, own_cum_score, opp_cum_score FROM silver"),
        "coop_rates": _sql(f"SELECT {_KEY}, own_coop_rate, opp_coop_rate FROM silver"),
        "opponent_last_move": _sql(f"SELECT {_KEY}, opponent_last_move FROM silver"),
        "defection_streak": _sql(f"SELECT {_KEY}, opponent_defection_streak FROM silver"),
        "forgave_retaliated": _sql(
            f"SELECT {_KEY}, forgave_this_turn, retaliated_this_turn FROM silver"
        ),
        "round_outcome": _sql(f"SELECT {_KEY}, round_outcome FROM silver"),
        "silver_turns": _sql("SELECT * FROM silver"),
        "stg_turns": _sql("SELECT * FROM stg"),
        "turn_key": _sql(f"SELECT {_KEY}, turn_key FROM fact"),
        "dim_agent": _sql("SELECT * FROM dim"),
        "fct_turns": _sql("SELECT * FROM fact"),
        "grim_state": _sql(f"SELECT {_KEY}, opp_defected_before FROM replay"),
        "expected_move": _sql(
            f"SELECT {_KEY}, player, opponent, player_coded_equivalent, move,"
            " expected_move FROM expected"
        ),
        "leaderboard": _sql("SELECT * FROM board"),
        "matchup_matrix": _sql("SELECT * FROM matchup"),
        "coop_over_time": _sql("SELECT * FROM overtime"),
        "llm_vs_coded": _sql("SELECT * FROM versus"),
        "persona_fidelity": _sql("SELECT * FROM fidelity"),
        "fidelity_by_opponent": _sql("SELECT * FROM fidelity_opp"),
        "reciprocity": _sql("SELECT * FROM recip"),
        "outcome_counts": _sql(
            "SELECT round_outcome, count(*) AS n FROM silver GROUP BY round_outcome"
        ),
        "silver_stats": _sql(
            "SELECT count(*) AS n_rows, count(DISTINCT match_id) AS n_matches FROM silver"
        ),
        "parse_move_json": _sql(f"SELECT {_KEY}, json_move FROM stages"),
        "parse_move_letter": _sql(f"SELECT {_KEY}, letter_move FROM stages"),
        "parse_move_keyword": _sql(f"SELECT {_KEY}, keyword_move FROM stages"),
        "extract_move": _sql(
            f"""SELECT {_KEY}, player,
                  coalesce(json_move, letter_move, keyword_move, 'C') AS parsed_move,
                  coalesce(json_move, letter_move, keyword_move) IS NOT NULL AS parsed_ok
                FROM stages"""
        ),
        "parse_audit": _sql(
            """SELECT player AS agent, CASE WHEN json_move IS NOT NULL THEN 'json'
                        WHEN letter_move IS NOT NULL THEN 'letter'
                        WHEN keyword_move IS NOT NULL THEN 'keyword' ELSE 'default' END
                        AS stage, count(*) AS n_answers
               FROM stages GROUP BY ALL"""
        ),
        "justification_rate": _sql(
            r"""SELECT player AS agent, count(*) AS n_answers,
                  count(*) FILTER (why_type = 'VARCHAR' AND regexp_matches(why_text, '\S'))
                    AS n_justified,
                  avg(CAST(coalesce(why_type = 'VARCHAR'
                           AND regexp_matches(why_text, '\S'), false) AS INT))
                    AS taux_justification
                FROM fields GROUP BY player"""
        ),
        "payload_schema_audit": _sql(
            """SELECT player AS agent, count(*) AS n_answers, count(obj) AS n_object,
                 count(move_type) AS n_move,
                 count(*) FILTER (move_type = 'VARCHAR') AS n_move_string,
                 count(*) FILTER (move_type = 'VARCHAR' AND move_text IN ('C', 'D'))
                   AS n_move_enum,
                 count(*) FILTER (move_type = 'VARCHAR' AND move_text IN ('C', 'D')
                   AND coalesce(why_type, 'VARCHAR') = 'VARCHAR') AS n_valid
               FROM fields GROUP BY player"""
        ),
        "history_summary": _sql(
            f"""SELECT {_KEY}, player, CASE WHEN n = 0 THEN 'Tour 1 — première interaction, '
                   || 'aucun historique disponible.'
                 ELSE 'Tour ' || (n + 1) || ' — ' || n || ' tour(s) joué(s). L''adversaire a '
                   || 'coopéré ' || oc || '/' || n || ' fois ('
                   || CAST(round_even(CAST(oc AS DOUBLE) / n * 100, 0) AS INT)
                   || '%). Toi-même as coopéré ' || mc || '/' || n || ' fois ('
                   || CAST(round_even(CAST(mc AS DOUBLE) / n * 100, 0) AS INT)
                   || '%). Au dernier tour, l''adversaire '
                   || CASE opponent_last_move WHEN 'C' THEN 'a coopéré' ELSE 't''a trahi' END
                   || '.' || CASE WHEN opponent_defection_streak > 0 THEN
                        ' Trahisons consécutives actuelles de l''adversaire : '
                        || opponent_defection_streak || '.' ELSE '' END
                   || ' Score cumulé — toi : ' || (own_cum_score - payoff)
                   || ', adversaire : ' || (opp_cum_score - opponent_payoff) || '.'
                 END AS memory_summary
               FROM (SELECT *, row_number() OVER w - 1 AS n,
                       count(*) FILTER (move = 'C') OVER w - CAST(move = 'C' AS INT) AS mc,
                       count(*) FILTER (opponent_move = 'C') OVER w
                         - CAST(opponent_move = 'C' AS INT) AS oc
                     FROM silver WINDOW w AS (PARTITION BY match_id, seat ORDER BY turn
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
        ),
        "report_kpis": _sql(
            """SELECT (SELECT count(DISTINCT match_id) FROM fact) AS n_matches,
                 (SELECT max(turn) FROM fact) AS max_turn, count(*) AS n_agents,
                 count(*) FILTER (agent_type = 'llm') AS n_llm,
                 count(*) FILTER (agent_type = 'coded') AS n_coded FROM board"""
        ),
        "report_extremes": _sql(
            """SELECT role, agent, score_moyen_par_tour, taux_cooperation FROM (
                 SELECT 'best' AS role, *, row_number() OVER (
                   ORDER BY score_moyen_par_tour DESC, agent) AS rk FROM board
                 UNION ALL SELECT 'worst', *, row_number() OVER (
                   ORDER BY score_moyen_par_tour, agent) FROM board
                 UNION ALL SELECT 'best_llm', *, row_number() OVER (
                   ORDER BY score_moyen_par_tour DESC, agent) FROM board
                   WHERE agent_type = 'llm') WHERE rk = 1"""
        ),
        "reciprocity_score_corr": _sql(
            """SELECT count(*) AS n_agents, CASE WHEN count(*) >= 3 THEN round(
                 covar_pop(reciprocite, score_moyen_par_tour) / nullif(
                   stddev_pop(reciprocite) * stddev_pop(score_moyen_par_tour), 0), 9) END
                 AS correlation
               FROM recip WHERE reciprocite IS NOT NULL"""
        ),
        "strict_fidelity": _sql(
            """SELECT persona, coded_equivalent, fidelite, riposte_attendue_respectee,
                 row_number() OVER (ORDER BY fidelite DESC, persona) = 1 AS is_most_faithful,
                 row_number() OVER (ORDER BY riposte_attendue_respectee, persona) = 1
                   AS is_least_retaliating
               FROM fidelity WHERE equivalence = 'stricte'"""
        ),
        "coop_phases": _sql(_PHASES),
        "coop_drift": _sql(
            f"""SELECT agent, derive FROM ({_PHASES})
                WHERE agent IN ('tit_for_tat', 'grim_trigger')
                   OR agent IN (SELECT agent FROM board WHERE agent_type = 'llm')"""
        ),
        "coop_filtered": _sql(f"SELECT * FROM overtime WHERE agent IN ({shown})"),
        "agent_list": _sql("SELECT DISTINCT player AS agent FROM bronze"),
        "match_list": _sql("SELECT DISTINCT match_id FROM bronze"),
        "default_match": _sql(
            """SELECT coalesce(min(match_id) FILTER (contains(match_id, 'persona')),
                               min(match_id)) AS match_id FROM bronze"""
        ),
        "match_replay": _sql(_REPLAY),
        "match_from_log": _sql(_REPLAY),
        "move_sequence": _sql(
            """SELECT match_id, seat, CAST((turn - 1) // 100000 AS BIGINT) AS segment,
                 string_agg(move, '' ORDER BY turn) AS sequence
               FROM bronze GROUP BY ALL"""
        ),
        "matchup_pivot": _sql(
            _pivot("player", "opponent", "score_moyen_par_tour", "matchup")
        ),
        "matchup_heat_map": _sql(
            """SELECT player, opponent, (place - 1) // 4 AS part, score_moyen_par_tour
               FROM matchup JOIN (SELECT opponent, row_number() OVER (ORDER BY opponent) AS place
                                  FROM (SELECT DISTINCT opponent FROM matchup)) USING (opponent)"""
        ),
        "match_counts_by_load": _sql(
            """SELECT 'pair' AS grain, player, opponent, count(DISTINCT match_id) AS n_matches
               FROM bronze GROUP BY ALL
               UNION ALL SELECT 'agent', player, NULL, count(DISTINCT match_id)
               FROM bronze GROUP BY ALL
               UNION ALL SELECT 'log', NULL, NULL, count(DISTINCT match_id) FROM bronze"""
        ),
        "fidelity_heatmap": _sql(
            """SELECT persona, opponent, fidelite FROM fidelity_opp
               WHERE fidelite IS NOT NULL"""
        ),
        "llm_vs_coded_gap": _sql(
            """SELECT *, score_moyen_persona - score_moyen_code AS ecart_score,
                 coop_persona - coop_code AS ecart_coop,
                 score_moyen_persona - score_moyen_code > 0 AS beats_rule FROM versus"""
        ),
        "coop_unpivot": _sql(
            """SELECT persona, 'coop_persona' AS source, coop_persona AS taux_cooperation
               FROM versus
               UNION ALL SELECT persona, 'coop_code', coop_code FROM versus"""
        ),
        "repeat_stddev": _sql(
            """SELECT agent, count(*) AS n_repeats, round(stddev_samp(score), 9) AS ecart_type
               FROM (SELECT player AS agent, repeat, avg(payoff) AS score FROM fact
                     GROUP BY ALL) GROUP BY agent"""
        ),
        "rank_delta": _sql(
            """SELECT agent, one.rk AS rang_un, one.score AS score_un, everything.rk AS rang_tous,
                 everything.score AS score_tous, everything.rk - one.rk AS delta_rang,
                 everything.score - one.score AS delta_score
               FROM (SELECT player AS agent, avg(payoff) AS score,
                       row_number() OVER (ORDER BY avg(payoff) DESC, player) AS rk
                     FROM fact GROUP BY player) everything
               LEFT JOIN (SELECT player AS agent, avg(payoff) AS score,
                       row_number() OVER (ORDER BY avg(payoff) DESC, player) AS rk
                     FROM fact WHERE repeat = 1 GROUP BY player) one USING (agent)"""
        ),
        "match_outliers": _sql(
            """SELECT match_id, seat, player, opponent, score_match, score_paire,
                 score_match - score_paire AS ecart
               FROM (SELECT match_id, seat, player, opponent, avg(payoff) AS score_match
                     FROM fact GROUP BY ALL)
               JOIN (SELECT player, opponent, avg(payoff) AS score_paire
                     FROM fact GROUP BY ALL) USING (player, opponent)"""
        ),
        "parse_reliability": _sql(
            """SELECT player AS agent, count(*) AS n_reponses,
                 count(*) FILTER (is_parsable) AS n_parsables,
                 avg(CAST(is_parsable AS INT)) AS taux_parsable
               FROM fact WHERE player_type = 'llm' GROUP BY player"""
        ),
        "dq_not_null": _sql(_DQ_NOT_NULL),
        "dq_unique": _sql(_DQ_UNIQUE),
        "dq_accepted_values": _sql(_DQ_VALUES),
        "dq_relationships": _sql(_DQ_RELATION),
        "dq_accepted_range": _sql(_DQ_RANGE),
        "dq_all": _sql(
            _union(_DQ_NOT_NULL, _DQ_UNIQUE, _DQ_VALUES, _DQ_RELATION, _DQ_RANGE)
        ),
    }
