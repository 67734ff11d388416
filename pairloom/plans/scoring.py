"""Rewards over rollouts, their joins, totals and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import fixed, rewards, tags
from pairloom.functions import text as T
from pairloom.operators import score
from pairloom.plans import duck as D
from pairloom.plans import inputs as I
from pairloom.plans.registry import query

KEY = "doc_id, line_no, gen_id"
steps = D.steps

# Check expressions over columns ``resp`` (stripped) and ``colon_source``.
SHARE = D.divide(D.count("resp", T.KATAKANA), D.nonspace("resp"))
SIZE = D.divide(f"length({D.packed('resp')})", f"length({D.packed('colon_source')})")
CHECKS = {
    "purity": steps(
        ("resp = ''", -3), (f"{SHARE} IS NULL", -2), (f"{SHARE} = 1", 4), (f"{SHARE} >= 0.98", 3.5),
        (f"{SHARE} >= 0.95", 3), (f"{SHARE} >= 0.9", 2), (f"{SHARE} >= 0.8", 1),
        (f"{SHARE} >= 0.6", 0.2), default=-2.5,
    ),
    "length": steps(
        (f"{SIZE} IS NULL", 0), (f"{SIZE} BETWEEN 0.9 AND 1.3", 3),
        (f"{SIZE} BETWEEN 0.8 AND 1.6", 2), (f"{SIZE} BETWEEN 0.6 AND 2.0", 0.8),
        (f"{SIZE} BETWEEN 0.4 AND 3.0", 0.2), (f"{SIZE} > 4", -3), (f"{SIZE} < 0.3", -2.5),
        default=-1.5,
    ),
    "unwanted": "(0 - (" + " + ".join(
        f"{D.count('resp', c)} * {w}::DOUBLE" for c, w in (
            ("a-zA-Z", 0.5), ("0-9", 0.4), (T.HIRAGANA, 0.8), (T.KANJI, 1.2), (T.SYMBOL, 0.3))
    ) + ") - CASE WHEN resp = '' THEN 3 ELSE 0 END)",
    "completeness": "(" + steps(
        ("length(resp) = 0", -4), ("length(resp) <= 2", -2), ("length(resp) <= 5", -0.5),
        ("length(resp) <= 80", 2), ("length(resp) <= 120", 1), ("length(resp) <= 200", -0.8),
        default=-2.5,
    ) + f" - CASE WHEN {D.phrase('resp', chr(10))} > 1 THEN {D.phrase('resp', chr(10))} * "
        "0.5::DOUBLE ELSE 0 END - CASE WHEN contains(resp, '  ') THEN 0.3::DOUBLE ELSE 0 END)",
    "format": "((" + " + ".join(D.phrase("resp", p) for p in fixed.UNWANTED_PHRASES)
        + ") * -0.4::DOUBLE + "
        + steps((f"{SHARE} = 1", 2.5), (f"{SHARE} >= 0.95", 1.8), (f"{SHARE} >= 0.9", 1.2), default=0)
        + " + CASE WHEN length(resp) BETWEEN 3 AND 30 AND "
        + f"{D.phrase('resp', ' ')} <= 2 THEN 0.8::DOUBLE ELSE 0 END)",
    "repetition": "(CASE WHEN resp = '' THEN 0::DOUBLE ELSE -0.5::DOUBLE * "
        "len(list_filter(list_distinct(string_split(resp, '')), "
        "lambda c: length(resp) - length(replace(resp, c, '')) > length(colon_source))) "
        f"- CASE WHEN len(list_distinct(string_split({D.packed('resp')}, ''))) < 3 "
        "AND length(resp) > 5 THEN 1.5 ELSE 0 END "
        f"- CASE WHEN length({D.packed('resp')}) < 3 AND length(colon_source) > 8 THEN 1 ELSE 0 END "
        "END)",
}


def _conversion_reward(name):
    @query(f"reward_{name}", f"""
WITH {D.ROLLOUTS}
SELECT {KEY}, round({CHECKS[name]}, 6) AS reward FROM stripped""")
    def run(spark, sf):
        scored = score.score(I.rollouts(spark, sf), [name], "prompt")
        return scored.select(*I.ROLLOUT_KEY, F.col(f"reward_{name}").alias("reward"))

    return run


for _name in CHECKS:
    _conversion_reward(_name)


COMPOSITE = " + ".join([
    steps(("share >= 0.95", 4), ("share >= 0.85", 2), ("share >= 0.7", 0.5), default=-3),
    "(hira * -0.8::DOUBLE + kanji * -1.2::DOUBLE)",
    steps(("size BETWEEN 0.8 AND 2.5", 2.5), ("size BETWEEN 0.6 AND 3.0", 1), ("size > 4", -4),
          ("size < 0.5", -3), default=0),
    steps(("marks_source = 0", 0), ("marks BETWEEN 0.8 AND 1.2", 1.5), ("marks < 0.5", -1),
          default=0),
    steps(("total >= source_total * 0.8::DOUBLE", 1.5), default=-2),
    steps((f"regexp_matches(resp, '{'|'.join(fixed.EXPLANATIONS)}')", -2), default=1),
    steps(("total = 0", 0), ("share >= 0.9", 1), ("share < 0.7", -1.5), default=0),
    steps(("latin > 0", 0.5), default=0),
])


@query("reward_composite", f"""
WITH {D.ROLLOUTS}, sourced AS (
  SELECT {KEY}, resp, {D.group('prompt', tags.SOURCE_PATTERN)} AS found FROM stripped),
counted AS (
  SELECT {KEY}, resp, found IS NOT NULL AS asked, {D.strip("coalesce(found, '')")} AS source,
         {D.count('resp', T.KATAKANA)} AS kata, {D.count('resp', T.HIRAGANA)} AS hira,
         {D.count('resp', T.KANJI)} AS kanji,
         {D.count('resp', 'a-zA-Z')} + {D.count('resp', T.FLAT_DIGIT)} AS latin,
         {D.count('resp', T.PUNCTUATION)} AS marks_resp FROM sourced),
measured AS (
  SELECT *, kata + hira + kanji + latin AS total,
         {D.ratio('kata', 'kata + hira + kanji + latin')} AS share,
         {D.ratio('length(resp)', 'length(source)')} AS size, {D.total('source')} AS source_total,
         {D.count('source', T.PUNCTUATION)} AS marks_source,
         {D.divide('marks_resp', D.count('source', T.PUNCTUATION))} AS marks FROM counted)
SELECT {KEY}, round(CASE WHEN NOT asked OR resp = '' THEN -5
  ELSE greatest({COMPOSITE}, -10) END, 6) AS reward FROM measured""")
def reward_composite(spark, sf):
    scored = score.score(I.rollouts(spark, sf), ["composite"], "prompt")
    return scored.select(*I.ROLLOUT_KEY, F.col("reward_composite").alias("reward"))


def _tag_counts(names, once, otherwise):
    return " + ".join(
        steps((f"{D.phrase('response', t)} = 1", once), default=otherwise) for t in names
    )


def _answer(kind, missing, equal, stripped, close, near, wrong, error):
    guess = D.group("response", D.PATTERNS[kind])
    points = steps(
        ("guess = answer", equal), (f"{D.strip('guess')} = {D.strip('answer')}", stripped),
        ("share IS NULL", error), ("share BETWEEN 0.9 AND 1.1", close),
        ("share BETWEEN 0.8 AND 1.2", near), default=wrong,
    )
    return f"""
WITH {D.NUMBERS}, guessed AS (SELECT *, {guess} AS guess FROM numbers),
divided AS (SELECT *, {D.divide(D.number('guess'), D.number('answer'))} AS share FROM guessed)
SELECT prompt_id, CASE WHEN guess IS NULL THEN {missing}::DOUBLE
  WHEN answer IS NULL THEN NULL ELSE {points} END AS reward FROM divided"""


def _number(kind, missing, equal, wrong):
    found = D.group("response", D.PATTERNS[kind])
    plain = "replace(found, ',', '')" if kind == "signed_number" else "found"
    points = steps(
        ("found IS NULL", missing), ("guess IS NULL OR truth IS NULL", 0),
        ("guess = truth AND NOT isnan(truth)", equal), default=wrong,
    )
    return f"""
WITH {D.NUMBERS}, located AS (SELECT *, {found} AS found FROM numbers),
parsed AS (SELECT *, {D.number(plain)} AS guess, {D.number('answer')} AS truth FROM located)
SELECT prompt_id, {points} AS reward FROM parsed"""


def _matched(kind):
    hit = f"regexp_matches(response, {D.q(D.PATTERNS[kind])})"
    return f"WITH {D.NUMBERS} SELECT prompt_id, {steps((hit, 3), default=0)} AS reward FROM numbers"


EMPTIED = f"""{D.NUMBERS},
emptied AS (
  SELECT prompt_id, prompt, answer, CASE WHEN prompt_id % 11 = 0 THEN '' ELSE response END AS response
  FROM numbers)"""
TAGS_STRICT = _tag_counts(rewards.ALL_TAGS, 0.5, -0.5)
NUMBER_CHECKS = {
    "format_exact_strict": _matched("strict"),
    "tags_strict": f"WITH {D.NUMBERS} SELECT prompt_id, {TAGS_STRICT} AS reward FROM numbers",
    "answer_strict": _answer("strict", 0, 3, 1.5, 0.5, 0.25, -1, -0.5),
    "number_strict": _number("number", 0, 1.5, 0),
    "format_exact_loose": _matched("loose"),
    "tags_loose": f"WITH {D.NUMBERS} SELECT prompt_id, "
                  f"{_tag_counts(rewards.ALL_TAGS[1:], 0.5, -1)} AS reward FROM numbers",
    "answer_loose": _answer("loose", -2, 5, 3.5, 2, 1.5, -2.5, -4.5),
    "number_loose": _number("signed_number", -2.5, 3.5, -1.5),
}


def _number_reward(name):
    @query(f"reward_{name}", NUMBER_CHECKS[name])
    def run(spark, sf):
        scored = score.score(I.number_rollouts(spark, sf), [name], "prompt", answer="answer")
        return scored.select("prompt_id", F.col(f"reward_{name}").alias("reward"))

    return run


for _name in NUMBER_CHECKS:
    _number_reward(_name)


@query("rollouts_joined", f"""
WITH {D.ROLLOUTS}
SELECT r.doc_id, r.line_no, r.gen_id, r.prompt, r.response, p.target AS answer
FROM rollouts r JOIN prompts p ON r.doc_id = p.doc_id AND r.line_no = p.line_no""")
def rollouts_joined(spark, sf):
    made = I.rollouts(spark, sf)
    asked = I.rollout_prompts(spark, sf)
    prompts = asked.select(
        *I.PAIR_KEY, F.concat(F.lit(fixed.INSTRUCTION), "source").alias("prompt")
    )
    answers = asked.select(*I.PAIR_KEY, F.col("target").alias("answer"))
    joined = score.join_rollouts(prompts, made.drop("prompt"), answers, I.PAIR_KEY)
    return joined.select(*I.ROLLOUT_KEY, "prompt", "response", "answer")


ALL_SCORED = ", ".join(f"round({c}, 6) AS reward_{n}" for n, c in CHECKS.items())
SCORED = f"{D.ROLLOUTS}, scored AS (SELECT {KEY}, resp, {ALL_SCORED} FROM stripped)"
TOTAL = "round(" + " + ".join(f"reward_{n}" for n in CHECKS) + ", 6)"


def _scored(spark, sf):
    return score.score(
        I.rollouts(spark, sf), rewards.CONVERSION_REWARDS, "prompt", total="reward_total"
    )


@query("reward_total", f"""
WITH {SCORED}
SELECT {KEY}, {', '.join(f'reward_{n}' for n in CHECKS)}, {TOTAL} AS reward_total FROM scored""")
def reward_total(spark, sf):
    return _scored(spark, sf).drop("prompt", "response")


@query("reward_group_stats", f"""
WITH {SCORED}
SELECT s.doc_id, s.line_no, count(*) AS n_generations, round(avg({TOTAL}), 6) AS reward,
       round(stddev_samp({TOTAL}), 6) AS reward_std,
       round(avg(length(r.response)), 6) AS completion_length
FROM scored s JOIN rollouts r ON s.doc_id = r.doc_id AND s.line_no = r.line_no
  AND s.gen_id = r.gen_id GROUP BY s.doc_id, s.line_no""")
def reward_group_stats(spark, sf):
    return score.group_stats(_scored(spark, sf), I.PAIR_KEY, "reward_total", "response")


@query("reward_step_log", f"""
WITH {SCORED}, groups AS (
  SELECT s.doc_id % 16 + 1 AS step, s.doc_id, s.line_no, count(*) AS n, avg({TOTAL}) AS reward,
         stddev_samp({TOTAL}) AS reward_std, avg(length(r.response)) AS completion_length
  FROM scored s JOIN rollouts r ON s.doc_id = r.doc_id AND s.line_no = r.line_no
    AND s.gen_id = r.gen_id GROUP BY ALL)
SELECT step, count(*) AS n_prompts, sum(n)::BIGINT AS n_generations, round(avg(reward), 6) AS reward,
       round(avg(reward_std), 6) AS reward_std, round(avg(completion_length), 6) AS completion_length
FROM groups GROUP BY GROUPING SETS ((step), ())""")
def reward_step_log(spark, sf):
    """Steps of prompts, as a training log shows them, and the row over all of them."""
    scored = _scored(spark, sf).withColumn("step", F.col("doc_id") % 16 + 1)
    return score.step_log(scored, "step", I.PAIR_KEY, "reward_total", "response")


def count_tags(completions, **columns):
    """The tag reward as a plain Python function over aligned lists."""
    responses = [c[0]["content"] if c else "" for c in completions]
    return [
        sum(0.5 if r.count(t) == 1 else -0.5 for t in rewards.ALL_TAGS) for r in responses
    ]


def asked_as_system(prompts, completions, answer, **columns):
    """Points for a prompt that opens with a system message, minus one without an answer."""
    return [
        float(p[0]["role"] == "system") + len(p) - (a is None) + 0.25 * (k % 3)
        for p, a, k in zip(prompts, answer, columns["prompt_id"], strict=True)
    ]


def _message_rollouts(spark, sf):
    """Number rollouts as message arrays; every eleventh completion is empty."""
    text, role = F.struct, F.lit
    key = F.col("prompt_id")
    user = text(role("user").alias("role"), F.col("prompt").alias("content"))
    system = text(role("system").alias("role"), F.lit(fixed.SYSTEM_PROMPT).alias("content"))
    said = F.array(text(role("assistant").alias("role"), F.col("response").alias("content")))
    return I.number_rollouts(spark, sf).select(
        "prompt_id", F.when(key % 2 == 0, F.array(system, user)).otherwise(F.array(user)).alias("prompt"),
        F.when(key % 11 == 0, F.slice(said, 1, 0)).otherwise(said).alias("completion"), "answer",
    )


@query("udf_reward_adaptor", f"""
WITH {EMPTIED}
SELECT prompt_id, {TAGS_STRICT} AS python_reward, {TAGS_STRICT} AS built_in_reward,
       CASE WHEN prompt_id % 2 = 0 THEN 3 ELSE 1 END - (answer IS NULL)::INTEGER
         + 0.25::DOUBLE * (prompt_id % 3) AS prompt_reward FROM emptied""")
def udf_reward_adaptor(spark, sf):
    rows = _message_rollouts(spark, sf)
    scored = score.score(rows, ["tags_strict"], "prompt", "completion", "answer")
    columns = {"prompts": F.col("prompt"), "completions": F.col("completion"), "answer": F.col("answer"),
               "prompt_id": F.col("prompt_id")}
    return scored.select(
        "prompt_id", rewards.python_reward(count_tags)(**columns).alias("python_reward"),
        F.col("reward_tags_strict").alias("built_in_reward"),
        rewards.python_reward(asked_as_system)(**columns).alias("prompt_reward"),
    )


@query("udf_pair_reward", f"""
WITH {EMPTIED}
SELECT prompt_id, (length(prompt) + 10 * length(response))::DOUBLE AS reward FROM emptied""")
def udf_pair_reward(spark, sf):
    adapted = rewards.python_pair_reward(lambda p, r: len(p) + 10 * len(r))
    rows = _message_rollouts(spark, sf)
    return rows.select(
        "prompt_id", adapted(prompts=F.col("prompt"), completions=F.col("completion")).alias("reward")
    )


@query("reward_message_arrays", f"""
WITH {EMPTIED}, stripped AS (SELECT prompt_id, {D.strip('response')} AS resp FROM emptied)
SELECT prompt_id, round({CHECKS['purity']}, 6) AS reward_purity,
       round({CHECKS['completeness']}, 6) AS reward_completeness,
       round({CHECKS['purity']} + {CHECKS['completeness']}, 6) AS total FROM stripped""")
def reward_message_arrays(spark, sf):
    scored = score.score(
        _message_rollouts(spark, sf), ["purity", "completeness"], "prompt", "completion", total="total"
    )
    return scored.select("prompt_id", "reward_purity", "reward_completeness", "total")


@query("rollouts_unmatched", """
SELECT o_orderkey AS prompt_id, CASE WHEN o_orderkey % 3 <> 0 THEN 'p' || o_orderkey END AS prompt,
       'r' || o_custkey AS response, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::VARCHAR END AS answer
FROM orders""")
def rollouts_unmatched(spark, sf):
    """A third of the completions have no prompt, a fifth no answer; all stay."""
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id"), "o_custkey")
    key = F.col("prompt_id")
    prompts = orders.where(key % 3 != 0).select(key, F.concat(F.lit("p"), key).alias("prompt"))
    answers = orders.where(key % 5 != 0).select(key, F.col("o_custkey").cast("string").alias("answer"))
    said = orders.select(key, F.concat(F.lit("r"), "o_custkey").alias("response"))
    return score.join_rollouts(prompts, said, answers, ["prompt_id"]).select("prompt_id", "prompt", "response", "answer")
