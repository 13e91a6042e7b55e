"""Training-example tables (family S) built from trajectories and chats.

Everything is a DataFrame transform: the strategy list is a tiny broadcast
table cross-joined with the (large) seeds table, prompts are ``format_string``
columns, (prompt, response) pairs come from running counts and an equi-join,
and the sample is a ``TakeOrderedAndProject`` on an md5 key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import round_to
from ..functions.ranking import hash_hex
from ..functions.sequence import DEFAULT_CHUNK, ordered_rank, running_sum

# Fixed values from the reference: the 21 command strategies, in their order.
STRATEGIES = {
    "minimal_clean": ["inspect_dataset", "query_cleaner", "apply 1", "apply 2", "inspect_dataset", "validate", "submit"],
    "inspect_model_first": ["inspect_dataset", "inspect_model", "query_cleaner", "apply 1", "inspect_dataset", "validate", "submit"],
    "clean_then_balance": ["inspect_dataset", "query_cleaner", "apply 1", "apply 2", "query_balancer", "apply 1", "inspect_dataset", "validate", "submit"],
    "reject_then_apply": ["inspect_dataset", "query_cleaner", "reject 1", "apply 2", "inspect_dataset", "validate", "submit"],
    "baseline_validate_first": ["inspect_dataset", "validate", "query_cleaner", "apply 1", "inspect_dataset", "validate", "submit"],
    "augment_path": ["inspect_dataset", "query_cleaner", "apply 1", "query_augmenter 0", "apply 1", "inspect_dataset", "validate", "submit"],
    "with_validator": ["inspect_dataset", "query_validator", "query_cleaner", "apply 1", "inspect_dataset", "validate", "submit"],
    "deep_clean_requery": ["inspect_dataset", "query_cleaner", "apply 1", "apply 2", "query_cleaner", "apply 1", "inspect_dataset", "validate", "submit"],
    "fast_submit": ["query_cleaner", "apply 1", "apply 2", "inspect_dataset", "submit"],
    "balance_heavy": ["inspect_dataset", "query_balancer", "apply 1", "query_cleaner", "apply 1", "inspect_dataset", "validate", "submit"],
    "reject_requery": ["inspect_dataset", "query_cleaner", "reject 1", "reject 2", "query_cleaner", "apply 1", "inspect_dataset", "validate", "submit"],
    "multi_augment": ["inspect_dataset", "query_cleaner", "apply 1", "query_augmenter 1", "apply 1", "inspect_dataset", "validate", "submit"],
    "model_then_balance": ["inspect_model", "query_balancer", "apply 1", "inspect_dataset", "validate", "submit"],
    "full_pipeline": ["inspect_dataset", "inspect_model", "query_cleaner", "apply 1", "query_balancer", "apply 1", "query_augmenter 0", "apply 1", "inspect_dataset", "validate", "submit"],
    "suboptimal_no_validate": ["inspect_dataset", "query_cleaner", "apply 1", "submit"],
    "inspect_only_submit": ["inspect_dataset", "inspect_model", "submit"],
    "reject_all_then_requery": ["inspect_dataset", "query_cleaner", "reject 1", "reject 2", "query_balancer", "apply 1", "inspect_dataset", "validate", "submit"],
    "apply3_then_validate": ["inspect_dataset", "query_cleaner", "apply 1", "apply 2", "query_balancer", "apply 1", "query_augmenter 0", "apply 1", "inspect_dataset", "validate", "submit"],
    "analyst_led_clean": ["query_analyst", "inspect_dataset", "query_cleaner", "apply 1", "apply 2", "validate", "submit"],
    "analyst_led_balance": ["query_analyst", "query_balancer", "apply 1", "query_cleaner", "apply 1", "validate", "submit"],
    "analyst_full_pipeline": ["query_analyst", "inspect_dataset", "inspect_model", "query_cleaner", "apply 1", "query_balancer", "apply 1", "validate", "submit"],
}
TASKS = ["task_0_tutorial", "task_1_easy", "task_2_medium", "task_3_hard"]
LAST_RESULT_CHARS = 400
SAMPLE_SIZE = 500
DOMINANT_PCT = 25.0

def strategies(spark) -> DataFrame:
    rows = [(i, name, acts) for i, (name, acts) in enumerate(STRATEGIES.items())]
    return spark.createDataFrame(rows, "strategy_pos int, strategy string, actions array<string>")


def expand(spark, seeds: DataFrame, seed_col: str = "seed", tasks=TASKS) -> DataFrame:
    """Strategies x tasks x seeds, one row per action (posexplode).  The
    strategy x task table is fixed-size (84 rows) and broadcast; seeds come
    from the data and carry the volume."""
    st = strategies(spark).crossJoin(spark.createDataFrame([(t,) for t in tasks], "task string"))
    j = seeds.select(F.col(seed_col).alias("seed")).distinct().crossJoin(F.broadcast(st))
    return j.select("strategy", "task", "seed", F.posexplode("actions").alias("step", "action"))


def _pct(c, d=1):
    return F.format_string(f"%.{d}f%%", round_to(c * 100.0, d))


def prompt(obs: DataFrame, accuracy="accuracy", target="target", quality="quality", rows_pct="rows_pct",
           budget="budget_remaining", validates="validates_left", session="session", response="response") -> DataFrame:
    """The per-step user prompt from observation columns; the last result is cut to 400 chars."""
    gap = F.greatest(F.lit(0.0), F.col(target) - F.col(accuracy))
    # fixed values: the labels and layout of the prompt format
    text = F.concat(
        F.lit("Current situation:\nAccuracy: "), _pct(F.col(accuracy)), F.lit(" → Target: "), _pct(F.col(target)),
        F.lit("\nStill need: "), _pct(gap), F.lit(" improvement\nQuality score: "),
        F.format_string("%.2f", round_to(F.col(quality), 2)), F.lit("/1.00\nRows preserved: "), _pct(F.col(rows_pct)),
        F.lit("\nBudget remaining: "), F.col(budget).cast("string"), F.lit(" steps\nFree validates left: "),
        F.col(validates).cast("string"), F.lit("\nActive query session: "), F.coalesce(F.col(session), F.lit("none")),
        F.lit("\n\nLast result:\n"), F.substring(F.coalesce(F.col(response), F.lit("")), 1, LAST_RESULT_CHARS),
        F.lit("\n\nWhat is your next action? (one command only)"))
    return obs.withColumn("prompt", text)


def pairs(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          prompt_role: str = "user", response_role: str = "assistant", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """S3: (latest earlier user message -> assistant message) per conversation.
    The k-th user message is found by a running count of user turns and an
    equi-join on (conversation, k): no conversation is windowed whole."""
    d = ordered_rank(conv, [conv_id], [turn], F.floor(F.col(turn) / F.lit(chunk)), "__pos")
    d = running_sum(d, [conv_id], "__pos", {"__u": (F.col(role) == prompt_role).cast("long")}, chunk)
    users = d.where(F.col(role) == prompt_role).select(conv_id, "__u", F.col(text).alias("prompt"),
                                                      F.col(turn).alias("prompt_turn"))
    asst = d.where((F.col(role) == response_role) & (F.col("__u") > 0)).select(
        conv_id, turn, "__u", F.col(text).alias("response"))
    return asst.join(users, [conv_id, "__u"]).select(conv_id, turn, "prompt_turn", "prompt", "response")


def chat(p: DataFrame, system_prompt: str) -> DataFrame:
    """System / user / assistant messages per example; the system text is the caller's."""
    msg = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                  F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
                  F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    return p.withColumn("messages", msg)


def sample(df: DataFrame, keys, n: int = SAMPLE_SIZE, seed=42) -> DataFrame:
    """Seeded shuffle and cap (the cap is the feature): smallest md5(seed|key) first."""
    return df.withColumn("__h", hash_hex(seed, *keys)).orderBy("__h", *keys).limit(n).drop("__h")


def diversity(df: DataFrame, prompt_col: str = "prompt", response_col: str = "response",
              relative_error: float | None = None) -> DataFrame:
    """S6 summary: total examples, unique responses, unique prompts (one row); exact, or
    with ``relative_error`` by mergeable sketches of fixed size."""
    unique = F.count_distinct if relative_error is None else lambda c: F.approx_count_distinct(c, relative_error)
    return df.agg(F.count(F.lit(1)).alias("total"), unique(response_col).alias("unique_responses"),
                  unique(prompt_col).alias("unique_prompts"))


def response_distribution(df: DataFrame, response_col: str = "response") -> DataFrame:
    """S6 detail: count and % per response, flagged when above 25%."""
    tot = df.agg(F.count(F.lit(1)).alias("__t"))
    c = df.groupBy(response_col).agg(F.count(F.lit(1)).alias("count"))
    pct = F.col("count") * 100.0 / F.col("__t")
    return c.crossJoin(F.broadcast(tot)).select(response_col, "count", pct.alias("pct"),
                                                (pct > DOMINANT_PCT).alias("dominant"))


#: Counters of one row of the frequency sketch, and its rows.
SKETCH_WIDTH, SKETCH_ROWS = 1024, 3


def dominant_responses(df: DataFrame, response_col: str = "response", min_pct: float = DOMINANT_PCT) -> DataFrame:
    """Exactly the responses above ``min_pct`` of all, with count and %, without a shuffle of all texts.

    A mergeable sketch (``SKETCH_ROWS`` rows of counters by hash) gives every response a count that is never too small;
    only rows whose counters all reach the share are counted by text.  A frequent response always passes; a rare one
    passes by chance only, and then its exact count drops it."""
    cell = lambda i: F.pmod(F.xxhash64(F.lit(i), F.col(response_col)), F.lit(SKETCH_WIDTH)).cast("int")
    cells = F.array(*[F.struct(F.lit(i).alias("i"), cell(i).alias("c")) for i in range(SKETCH_ROWS)])
    given = df.where(F.col(response_col).isNotNull())
    tot = df.agg(F.count(F.lit(1)).alias("__t"))
    sketch = given.select(F.explode(cells).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    heavy = sketch.crossJoin(F.broadcast(tot)).where(F.col("n") * 100.0 > F.col("__t") * min_pct)
    # fewer than 100 / min_pct counters of a row can be heavy
    keep = heavy.agg(F.collect_set("x").alias("__heavy"))
    seen = F.lit(True)
    for i in range(SKETCH_ROWS):
        seen = seen & F.array_contains("__heavy", F.struct(F.lit(i).alias("i"), cell(i).alias("c")))
    cand = given.crossJoin(F.broadcast(keep)).where(seen)  # one row
    c = cand.groupBy(response_col).agg(F.count(F.lit(1)).alias("count"))
    pct = F.col("count") * 100.0 / F.col("__t")
    return c.crossJoin(F.broadcast(tot)).where(pct > min_pct).select(response_col, "count", pct.alias("pct"))
