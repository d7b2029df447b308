"""Question answering, re-aimed as batch operators over a table of questions.

Routing is a sum of keyword ``contains`` tests per topic and a struct max.
Branch extraction and linking are projections over the branch list, one
ordered array in a one-row frame, while the list is counted to be at most
``LISTED`` names.  A longer list is an inverted index: every name stands under
its rarest run of ``GRAM`` characters, a text asks for all of its runs, and what
they share is verified, so only texts and names that may match ever meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTED = 1000  # names in one array
GRAM = 4

# Topic keywords of the reference (topic order breaks ties).
QUERY_KEYWORDS = [
    ("combo", ["combo", "bundle", "pair", "cross-sell", "upsell", "together"]),
    ("demand", ["demand", "forecast", "predict", "sales projection", "next month", "q1"]),
    ("expansion", ["expand", "new branch", "new location", "feasibility", "open"]),
    ("staffing", ["staff", "employee", "shift", "schedule", "hire", "hiring", "workforce"]),
    ("beverage", ["coffee", "milkshake", "frappe", "beverage", "drink", "growth strategy"]),
]


def route_questions(questions: DataFrame, keywords=QUERY_KEYWORDS, text: str = "question") -> DataFrame:
    """SRV-1: best topic per question (zero score -> ``full_summary``)."""
    q = F.lower(F.col(text))
    scored = [F.struct(sum(F.when(q.contains(k), 1).otherwise(0) for k in kws).alias("score"),
                       F.lit(-i).alias("neg_order"), F.lit(topic).alias("topic"))
              for i, (topic, kws) in enumerate(keywords)]
    best = F.greatest(*scored)
    return questions.select("question_id", best["score"].cast("int").alias("score"),
                            F.when(best["score"] > 0, best["topic"]).otherwise("full_summary").alias("topic"))


def _listed(branches: DataFrame) -> DataFrame:
    """The branch list as one ordered array in a one-row frame: (position, name, lower-case name) each; at most ``LISTED`` names."""
    one = F.struct(F.col("list_pos").alias("p"), F.col("branch").alias("b"), F.lower("branch").alias("l"))
    return F.broadcast(branches.agg(F.array_sort(F.collect_list(one)).alias("_list")))


def _short(branches: DataFrame) -> bool:
    return branches.limit(LISTED + 1).count() <= LISTED


def _all_grams(text: str) -> Column:
    """Every run of 1 to ``GRAM`` characters of a text, and the empty one: whatever a text contains has its own gram among them."""
    sizes = [F.expr(f"if(length({text}) >= {n}, transform(sequence(1, length({text}) - {n - 1}), i -> substring({text}, i, {n})), array())")
             for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *sizes))


def _own_gram(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``gram``: of each distinct text its rarest run of ``GRAM`` characters; a shorter text is its own."""
    t = df.select(text).distinct()
    runs = F.expr(f"if(length({text}) > {GRAM}, transform(sequence(1, length({text}) - {GRAM - 1}), i -> substring({text}, i, {GRAM})), array({text}))")
    held = t.select(text, F.explode(F.array_distinct(runs)).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    best = held.join(often, "gram").groupBy(text).agg(F.min(F.struct("_n", "gram")).alias("_g"))
    return df.join(best.select(text, F.col("_g.gram").alias("gram")), text)


def _names(branches: DataFrame) -> DataFrame:
    return branches.where(F.col("branch").isNotNull()).select(F.col("branch").alias("_b"), F.lower("branch").alias("_l"), F.col("list_pos").alias("_p"))


def _contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(_q, _b, _l, _p): the names that a text ``_q`` contains, through the inverted index of the names' rarest grams."""
    met = texts.select("_q", F.explode(_all_grams("_q")).alias("gram")).join(_own_gram(names, "_l"), "gram")
    return met.where(F.contains("_q", "_l")).select("_q", "_b", "_l", "_p")


def extract_branch(questions: DataFrame, branches: DataFrame, text: str = "question") -> DataFrame:
    """SRV-2: first listed branch (column ``branch``, order ``list_pos``) contained in the text."""
    q = F.lower(F.col(text))
    if _short(branches):
        return questions.crossJoin(_listed(branches)).select(
            "question_id", F.get(F.filter("_list", lambda x: F.contains(q, x["l"])), 0)["b"].alias("branch"))
    asked = questions.select("question_id", q.alias("_q"))
    found = _contained(asked.select("_q").where(F.col("_q").isNotNull()).distinct(), _names(branches))
    first = found.groupBy("_q").agg(F.min_by("_b", F.struct("_p", "_b")).alias("branch"))
    return asked.join(first, "_q", "left").select("question_id", "branch")


def link_branch(names: DataFrame, candidates: DataFrame, name: str = "name") -> DataFrame:
    """SRV-3: case-insensitive exact match, else containment either way; first candidate wins."""
    n = F.lower(F.trim(F.col(name)))
    if _short(candidates):
        exact = F.filter("_list", lambda x: x["l"] == n)
        near = F.filter("_list", lambda x: F.contains(n, x["l"]) | F.contains(x["l"], n))
        return names.select(name).distinct().crossJoin(_listed(candidates)).select(
            name, F.coalesce(F.get(exact, 0)["b"], F.get(near, 0)["b"]).alias("branch"))
    asked = names.select(name).distinct().withColumn("_q", n)
    texts, listed = asked.select("_q").where(F.col("_q").isNotNull()).distinct(), _names(candidates)
    holds = listed.select("*", F.explode(_all_grams("_l")).alias("gram")).join(_own_gram(texts, "_q"), "gram")
    found = _contained(texts, listed).unionByName(holds.where(F.contains("_l", "_q")).select("_q", "_b", "_l", "_p"))
    first = found.groupBy("_q").agg(F.min_by("_b", F.struct(F.col("_l") != F.col("_q"), "_p", "_b")).alias("branch"))
    return asked.join(first, "_q", "left").select(name, "branch")


def branch_lookup(requests: DataFrame, by_branch: DataFrame, top_n: int = 5) -> DataFrame:
    """SRV-4 (combo topic): top-n branch combos for each requested branch name (case-insensitive exact match, as the
    reference's combo getter).  ``by_branch`` must hold as many ranks as are asked for."""
    r = requests.select(F.col("name"), F.lower(F.trim("name")).alias("_k"))
    t = by_branch.where(F.col("branch_rank") <= top_n).withColumn("_k", F.lower("branch"))
    return r.join(t, "_k").drop("_k")


def topic_lookup(requests: DataFrame, table: DataFrame, candidates: DataFrame, name: str = "name") -> DataFrame:
    """SRV-4 (demand, staffing and beverage topics): the row of ``table`` for each requested name, linked as in
    ``link_branch``; ``found`` is false, and the row empty, where the name fits no branch."""
    linked = link_branch(requests, candidates, name)
    return linked.join(table, "branch", "left").withColumn("found", F.col("branch").isNotNull())


def headlines(two: DataFrame, by_branch: DataFrame, fsum: DataFrame, verd: DataFrame, health: DataFrame,
              staff: DataFrame, growth: DataFrame) -> DataFrame:
    """(topic, branch, headline, figure): one row per topic and branch, and one with NULL branch for the network."""
    def rows(df: DataFrame, topic: str, headline, figure: str, branch=None) -> DataFrame:
        return df.select(F.lit(topic).alias("topic"),
                         (F.lit(None).cast("string") if branch is None else F.col(branch)).alias("branch"),
                         headline.alias("headline"), F.col(figure).cast("double").alias("figure"))

    def network(df: DataFrame, headline: str, figure: str) -> DataFrame:  # the same value in every row
        return df.agg(F.first(headline).alias(headline), F.first(figure).alias(figure))

    verdict = verd.select("verdict").crossJoin(health.select("network_health_score"))
    total = verd.select("verdict").crossJoin(fsum.agg(F.first("network_horizon_total").alias("network_horizon_total")))
    growing = F.when(F.col("forecast_vs_historical") > 0, "growing").when(
        F.col("forecast_vs_historical") < 0, "declining").otherwise("stable")
    parts = [
        rows(by_branch.where("branch_rank = 1"), "combo", F.col("combo_name"), "co_purchase_count", "branch"),
        rows(two.where("rank = 1"), "combo", F.col("combo_name"), "lift"),
        rows(fsum, "demand", growing, "horizon_total_forecast", "branch"),
        rows(network(fsum, "fastest_growing_branch", "network_horizon_total"), "demand",
             F.col("fastest_growing_branch"), "network_horizon_total"),
        rows(verdict, "expansion", F.col("verdict"), "network_health_score"),
        rows(staff, "staffing", F.col("hiring_action"), "suggested_additional", "branch"),
        rows(network(staff, "most_efficient_branch", "network_total_employees"), "staffing",
             F.col("most_efficient_branch"), "network_total_employees"),
        rows(growth, "beverage", F.concat_ws(" ", "top_priority_action", "top_priority_category"), "estimated_uplift", "branch"),
        rows(network(growth, "best_beverage_branch", "total_estimated_uplift"), "beverage",
             F.col("best_beverage_branch"), "total_estimated_uplift"),
        rows(total, "full_summary", F.col("verdict"), "network_horizon_total")]
    return reduce(DataFrame.unionByName, parts)


def answer_questions(questions: DataFrame, places: DataFrame, home: DataFrame, table: DataFrame) -> DataFrame:
    """Route every question, find the place it names, and answer with the headline of its topic and branch.

    ``home`` maps places to branches (a dimension).  Expansion and the full summary are about the network, whatever place
    is named; other topics answer for the branch if one is named.  ``table`` has a row per topic and branch, so the join
    is left to adaptive execution; the topic and branch of a question are projections.
    """
    routed = route_questions(questions).select("question_id", "topic")
    placed = extract_branch(questions, places).withColumnRenamed("branch", "place").join(home, "place", "left")
    about = placed.join(routed, "question_id").select(
        "question_id", "topic", F.when(~F.col("topic").isin("expansion", "full_summary"), F.col("branch")).alias("branch"))
    t = table.select(F.col("topic").alias("_t"), F.col("branch").alias("_b"), "headline", "figure")
    return about.join(t, (F.col("topic") == F.col("_t")) & F.col("branch").eqNullSafe(F.col("_b")), "left").select(
        "question_id", "topic", "branch", "headline", "figure")


def full_summary(two: DataFrame, three: DataFrame, fsum: DataFrame, verd: DataFrame, health: DataFrame,
                 staff: DataFrame, growth: DataFrame) -> DataFrame:
    """SRV-5: one row of headline values of the five objectives."""
    combo = (two.agg(F.max(F.when(F.col("rank") == 1, F.col("combo_name"))).alias("top_combo"),
                     F.count(F.lit(1)).alias("_n2"))
             .crossJoin(three.agg(F.count(F.lit(1)).alias("_n3")))
             .select("top_combo", (F.col("_n2") + F.col("_n3")).alias("total_combos")))
    dem = fsum.agg(F.first("network_horizon_total").alias("network_horizon_total"),
                   F.first("fastest_growing_branch").alias("fastest_growing"))
    exp = verd.select("verdict").crossJoin(health.select(F.col("network_health_score").alias("health_score")))
    stf = staff.agg(F.first("network_total_employees").alias("total_employees"),
                    F.first("most_efficient_branch").alias("most_efficient"))
    bev = growth.agg(F.first("best_beverage_branch").alias("best_beverage_branch"),
                     F.first("total_estimated_uplift").alias("total_uplift"))
    return combo.crossJoin(dem).crossJoin(exp).crossJoin(stf).crossJoin(bev)


def branch_list(fsum: DataFrame) -> DataFrame:
    """SRV-6: branch name, horizon forecast and relative change."""
    return fsum.select("branch", "horizon_total_forecast", "forecast_vs_historical")
