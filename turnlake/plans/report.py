"""Report queries over the marts and the fact.

Functions that pick or rank break ties by agent name. Whole-table numbers that a query
compares its rows with are scalar subqueries, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.functions.turns import named, ratio
from turnlake.operators.gold import MEAN_PAYOFF
from turnlake.operators.skew import RANGE_ROWS, numbered_by_range

PHASE_TURNS = 10
# Opponents in one part of the heat map's rows.
HEAT_MAP_COLUMNS = 1024
# Rule agents that the drift report shows beside the personas.
DRIFT_RULES = ["tit_for_tat", "grim_trigger"]
REPLAY_COLUMNS = ["turn", "move", "opponent_move", "payoff", "own_cum_score", "round_outcome"]


# Order in which each mart is shown. Written marts have no order.
PRESENTATION = {
    "agg_agent_leaderboard": ["score_moyen_par_tour DESC", "agent"],
    "agg_matchup_matrix": ["player", "score_moyen_par_tour DESC", "opponent"],
    "agg_cooperation_over_time": ["agent", "turn", "agent_type"],
    "agg_persona_fidelity": ["fidelite DESC", "persona"],
    "agg_persona_fidelity_by_opponent": ["persona", "fidelite", "opponent"],
    "agg_reciprocity": ["reciprocite DESC", "agent", "agent_type"],
}


def _presentation(name: str) -> list[Column]:
    def order(key: str) -> Column:
        column = F.col(key.removesuffix(" DESC"))
        return column.desc_nulls_last() if key.endswith(" DESC") else column.asc_nulls_last()

    return [order(key) for key in PRESENTATION[name]]


def presented(mart: DataFrame, name: str) -> DataFrame:
    """The mart in its order of presentation, rows without the measure last."""
    return mart.orderBy(*_presentation(name))


def placed(
    mart: DataFrame, name: str, row: list[str], range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(mart, row, place): the columns ``row`` as text, and their place in the presentation.

    A task numbers about ``range_rows`` rows of the mart.
    """
    order = []
    for key in PRESENTATION[name]:
        column = F.col(key.removesuffix(" DESC"))
        order += [column.isNull(), -column if key.endswith(" DESC") else column]
    rows = numbered_by_range(mart, [], order, "place", range_rows)
    return rows.select(
        F.lit(name).alias("mart"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in row]).alias("row"),
        F.col("place").cast("int").alias("place"),
    )


def kpis(totals: DataFrame, board: DataFrame) -> DataFrame:
    """Header numbers: matches, longest match, agents in total and by type."""
    log = totals.agg(
        F.expr("struct(count(DISTINCT match_id) AS n_matches, max(last_turn) AS max_turn)")
    ).scalar()
    agents = {
        "n_agents": "count(*)",
        "n_llm": "count_if(agent_type = 'llm')",
        "n_coded": "count_if(agent_type = 'coded')",
    }
    return board.agg(*named(agents)).select(
        log.getField("n_matches").alias("n_matches"),
        log.getField("max_turn").alias("max_turn"),
        *agents,
    )


def extremes(board: DataFrame) -> DataFrame:
    """The best agent, the worst one and the best model-played one, with score and rate."""
    score = F.col("score_moyen_par_tour")
    kept = F.struct(
        F.col("agent"), score.alias("score"), F.col("taux_cooperation").alias("coop")
    )

    def first(order: Column, among: Column | None = None) -> Column:
        counts = score.isNotNull() if among is None else score.isNotNull() & among
        return F.min(F.when(counts, F.struct(order.alias("rank"), kept.alias("row"))))

    picked = board.agg(
        first(-score).alias("best"),
        first(score).alias("worst"),
        first(-score, F.col("agent_type") == "llm").alias("best_llm"),
    )
    rows = picked.unpivot([], ["best", "worst", "best_llm"], "role", "pick")
    return rows.where("pick IS NOT NULL").select(
        "role",
        F.col("pick.row.agent").alias("agent"),
        F.col("pick.row.score").alias("score_moyen_par_tour"),
        F.col("pick.row.coop").alias("taux_cooperation"),
    )


def reciprocity_score_corr(mart: DataFrame) -> DataFrame:
    """Pearson correlation of reciprocity and score over agents that have a reciprocity.

    NULL below three agents, and where either side does not vary.
    """
    x, y = "reciprocite", "score_moyen_par_tour"
    pearson = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    stats = mart.dropna(subset=[x]).agg(
        F.count(F.lit(1)).alias("n_agents"), pearson.alias("r")
    )
    return stats.select(
        "n_agents", F.when(F.col("n_agents") >= 3, F.col("r")).alias("correlation")
    )


def strict_fidelity(fidelity: DataFrame) -> DataFrame:
    """Personas meant to follow a rule strictly, with the most faithful one and the one that
    least often defects where its rule demands it.

    Both picks come from one row of the mart's minima, so personas are in no common window.
    """
    strict = fidelity.where("equivalence = 'stricte'")

    def first(value: str, order: str) -> str:
        return f"min(CASE WHEN {value} IS NOT NULL THEN struct({order} AS o, persona) END).persona"

    picks = {
        "faithful": first("fidelite", "-fidelite"),
        "least": first("riposte_attendue_respectee", "riposte_attendue_respectee"),
    }
    found = strict.agg(F.struct(*named(picks))).scalar()
    return strict.select(
        "persona",
        "coded_equivalent",
        "fidelite",
        "riposte_attendue_respectee",
        F.col("persona").eqNullSafe(found.getField("faithful")).alias("is_most_faithful"),
        F.col("persona").eqNullSafe(found.getField("least")).alias("is_least_retaliating"),
    )


def coop_phases(coop_time: DataFrame, phase: int = PHASE_TURNS) -> DataFrame:
    """Cooperation in the first and last turns of the longest match, and the change.

    Both are plain means over the turns' rates. Agents without turns on a side drop out.
    """
    last = coop_time.agg(F.max("turn")).scalar()
    turn, rate = F.col("turn"), F.col("taux_cooperation")
    sides = coop_time.where((turn <= phase) | (turn > last - phase)).select(
        "agent",
        F.when(turn <= phase, rate).alias("early"),
        F.when(turn > last - phase, rate).alias("late"),
    )
    levels = sides.groupBy("agent").agg(
        F.avg("early").alias("coop_debut"), F.avg("late").alias("coop_fin")
    )
    both = levels.dropna(subset=["coop_debut", "coop_fin"])
    return both.withColumn("derive", F.col("coop_fin") - F.col("coop_debut"))


def coop_drift(coop_time: DataFrame, board: DataFrame) -> DataFrame:
    """The change for model-played agents and the reactive rules."""
    shown = board.where(
        (F.col("agent_type") == "llm") | F.col("agent").isin(DRIFT_RULES)
    ).select("agent")
    return coop_phases(coop_time).join(shown, "agent", "left_semi").select("agent", "derive")


def coop_filtered(coop_time: DataFrame, agents: list[str]) -> DataFrame:
    return coop_time.where(F.col("agent").isin(agents))


def agent_list(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("player").alias("agent")).distinct().orderBy("agent")


def match_list(turns: DataFrame) -> DataFrame:
    return turns.select("match_id").distinct().orderBy("match_id")


def default_match(turns: DataFrame) -> DataFrame:
    """The first match with a persona by id, otherwise the first match."""
    ids = F.col("match_id")
    persona = F.min(F.when(ids.contains("persona"), ids))
    return turns.agg(F.coalesce(persona, F.min(ids)).alias("match_id"))


def match_replay(turns: DataFrame, match: Column) -> DataFrame:
    """The turns of one match; the filter on the match reaches the scan.

    ``turns`` needs the silver columns; raw answers show for model-played seats.
    """
    raw = F.when(F.col("player_type") == "llm", F.col("raw_output")).alias("raw_output")
    return turns.where(F.col("match_id") == match).select(
        "match_id", "seat", "player", *REPLAY_COLUMNS, raw
    )


def move_sequence(turns: DataFrame, segment_turns: int = 100_000) -> DataFrame:
    """Each seat's moves as text, one row per ``segment_turns`` turns.

    Matches of ordinary length are segment 0; a very long one never has to fit one string.
    """
    segment = F.expr(f"(turn - 1) div {segment_turns}").alias("segment")
    moves = F.array_sort(F.collect_list(F.struct("turn", "move")))
    text = F.array_join(F.transform(moves, lambda m: m["move"]), "")
    return turns.groupBy("match_id", "seat", segment).agg(text.alias("sequence"))


def matchup_pivot(mart: DataFrame, opponents: list[str] | None = None) -> DataFrame:
    """Mean scores with one column per opponent; all opponents of the mart by default.

    With a list, scores against opponents outside it are not lost: the column ``others`` holds
    them as text, "opponent=score" by name, NULL where there are none, and ``n_others`` counts
    them. ``heat_map_rows`` has all scores as numbers.
    """
    score = "score_moyen_par_tour"
    if opponents is None:
        return mart.groupBy("player").pivot("opponent").agg(F.first(score))
    columns = [F.max(F.when(F.col("opponent") == o, F.col(score))).alias(o) for o in opponents]
    is_other = ~F.col("opponent").isin(opponents)
    pair = F.concat("opponent", F.lit("="), F.col(score).cast("string"))
    told = F.collect_list(F.when(is_other, F.struct("opponent", pair.alias("pair"))))
    others = F.nullif(F.array_join(F.array_sort(told)["pair"], ", "), F.lit(""))
    return mart.groupBy("player").agg(
        *columns, others.alias("others"), F.count_if(is_other).alias("n_others")
    )


def heat_map_rows(
    mart: DataFrame, width: int = HEAT_MAP_COLUMNS, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """(player, part, scores): the matchup heat map for any number of agents, as numbers.

    Opponents are numbered by name, and part k holds the scores against those from
    ``k * width + 1`` on as a map by opponent, the same ones for every player. So a map has at
    most ``width`` entries however many agents there are. Pairs that never met have no entry,
    and rows without a player or an opponent are left out.
    """
    cells = mart.where("player IS NOT NULL AND opponent IS NOT NULL")
    opponents = numbered_by_range(
        cells.select("opponent").distinct(), [], [F.col("opponent")], "_place", range_rows
    )
    part = F.expr(f"(_place - 1) div {width}").alias("part")
    placed = cells.join(opponents.select("opponent", part), "opponent")
    entry = F.struct("opponent", "score_moyen_par_tour")
    scores = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return placed.groupBy("player", "part").agg(scores.alias("scores"))


def heat_map_cells(rows: DataFrame) -> DataFrame:
    """(player, opponent, part, score_moyen_par_tour): the cells of ``heat_map_rows``, one a row."""
    cell = F.explode("scores").alias("opponent", "score_moyen_par_tour")
    return rows.select("player", "part", cell)


def fidelity_heatmap(mart: DataFrame) -> DataFrame:
    return mart.dropna(subset=["fidelite"]).select("persona", "opponent", "fidelite")


def persona_gaps(mart: DataFrame) -> DataFrame:
    """Score and cooperation of each persona less its rule's, and whether it scores above."""
    gap = F.col("score_moyen_persona") - F.col("score_moyen_code")
    coop = F.col("coop_persona") - F.col("coop_code")
    return mart.withColumns(
        {"ecart_score": gap, "ecart_coop": coop, "beats_rule": gap > 0}
    )


def coop_unpivot(mart: DataFrame) -> DataFrame:
    return mart.unpivot(
        ["persona"], ["coop_persona", "coop_code"], "source", "taux_cooperation"
    )


def repeat_stddev(totals: DataFrame) -> DataFrame:
    """Spread of an agent's mean score over the repeats: the sample standard deviation."""
    per_repeat = totals.groupBy("player", "repeat").agg(*named({"score": MEAN_PAYOFF}))
    spread = {"n_repeats": "count(*)", "ecart_type": "stddev_samp(score)"}
    return per_repeat.groupBy(F.col("player").alias("agent")).agg(*named(spread))


def rank_delta(
    totals: DataFrame, repeat: int = 1, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Each agent's score and rank in one repeat and in all of them, and the changes.

    A task ranks about ``range_rows`` agents, however many have the same score.
    """

    def in_one(column: str) -> str:
        return f"sum(CASE WHEN repeat = {repeat} THEN {column} END)"

    measures = {"one": ratio(in_one("payoff"), in_one("n_payoff")), "all": MEAN_PAYOFF}
    scores = totals.groupBy(F.col("player").alias("agent")).agg(*named(measures))
    ranked = numbered_by_range(
        scores.unpivot(["agent"], ["one", "all"], "subset", "score").where("score IS NOT NULL"),
        ["subset"],
        [-F.col("score"), F.col("agent")],
        "rank",
        range_rows,
    )

    def of(subset: str, value: str) -> str:
        return f"max(CASE WHEN subset = '{subset}' THEN {value} END)"

    sides = {
        "rang_un": of("one", "rank"),
        "score_un": of("one", "score"),
        "rang_tous": of("all", "rank"),
        "score_tous": of("all", "score"),
    }
    return ranked.groupBy("agent").agg(*named(sides)).selectExpr(
        "*",
        "rang_tous - rang_un AS delta_rang",
        "score_tous - score_un AS delta_score",
    )


def match_outliers(totals: DataFrame) -> DataFrame:
    """Mean score of each seat in each match, and its distance from the mean of that pair.

    The totals are made once and serve both grains. A few pairs hold all matches: Spark broadcasts
    the pair means where it finds them small, and else splits the hot pairs of the join.
    """
    mean = named({"score_paire": MEAN_PAYOFF})
    pairs = totals.groupBy("player", "opponent").agg(*mean)
    names = ["match_id", "seat", "player", "opponent"]
    matches = totals.selectExpr(*names, ratio("payoff", "n_payoff") + " AS score_match")
    # Without a condition on nulls, which would give the two sides different readings of the log.
    same = F.expr("matches.player <=> pairs.player AND matches.opponent <=> pairs.opponent")
    joined = matches.alias("matches").join(pairs.alias("pairs"), same, "left").select(
        "matches.*", "score_paire"
    )
    return joined.selectExpr(
        *names, "score_match", "score_paire", "score_match - score_paire AS ecart"
    )


def parse_reliability(totals: DataFrame) -> DataFrame:
    """Model answers per agent and the share that could be read."""
    measures = {
        "n_reponses": "sum(n_answers)",
        "n_parsables": "sum(n_parsable)",
        "taux_parsable": ratio("sum(n_parsable)", "sum(n_answers)"),
    }
    answered = totals.where("player_type = 'llm'")
    return answered.groupBy(F.col("player").alias("agent")).agg(*named(measures))
