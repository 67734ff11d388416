"""Conversations, prompts, chat text, masks and padded arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import chat, fixed, tags
from pairloom.operators import batches, turns
from pairloom.plans import duck as D
from pairloom.plans import inputs as I
from pairloom.plans.registry import query


def _roles(messages):
    return F.array_join(F.transform(messages, lambda m: m["role"]), ",")


def _content(messages, position):
    return F.element_at(messages, position)["content"]


@query("sft_conversations", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, 'user,assistant' AS roles,
       {D.q(fixed.INSTRUCTION)} || kanji_text AS user_content,
       katakana_text AS assistant_content FROM pairs""")
def sft_conversations(spark, sf):
    messages = chat.conversation(F.col("kanji_text"), F.col("katakana_text"))
    return I.pairs(spark, sf).withColumn("conversations", messages).select(
        *I.PAIR_KEY, _roles("conversations").alias("roles"),
        _content("conversations", 1).alias("user_content"),
        _content("conversations", 2).alias("assistant_content"),
    )


@query("grpo_prompts", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no, 'user' AS roles, {D.q(fixed.INSTRUCTION)} || kanji_text AS prompt_content,
       kanji_text, katakana_text AS expected_katakana, length(kanji_text) AS original_length,
       length(katakana_text) AS target_length FROM pairs""")
def grpo_prompts(spark, sf):
    prompts = I.pairs(spark, sf).select(
        *I.PAIR_KEY, chat.conversion_prompt(F.col("kanji_text")).alias("prompt"), "kanji_text",
        F.col("katakana_text").alias("expected_katakana"),
        F.length("kanji_text").alias("original_length"),
        F.length("katakana_text").alias("target_length"),
    )
    return prompts.withColumns({
        "roles": _roles("prompt"), "prompt_content": _content("prompt", -1)
    }).drop("prompt")


@query("seq2seq_prompts", f"""
WITH {D.PAIRS}
SELECT doc_id, line_no,
       '漢字をカタカナに変換してください。' || chr(10) || '入力: ' || kanji_text || chr(10)
         || '出力: ' || katakana_text AS train_text,
       '漢字をカタカナに変換してください。' || chr(10) || '入力: ' || kanji_text || chr(10)
         || '出力: ' AS infer_text
FROM pairs""")
def seq2seq_prompts(spark, sf):
    source, target = F.col("kanji_text"), F.col("katakana_text")
    return I.pairs(spark, sf).select(
        *I.PAIR_KEY, chat.seq2seq_prompt(source, target).alias("train_text"),
        chat.seq2seq_prompt(source).alias("infer_text"),
    )


@query("alpaca_text", f"""
WITH {D.EXCHANGES}, triples AS (
  SELECT conv_id, turn, split_part(question, chr(10), 1) AS instruction,
         substr(question, length(split_part(question, chr(10), 1)) + 2) AS context, reply
  FROM exchanges)
SELECT conv_id, turn, {D.q(fixed.ALPACA_HEAD)} || chr(10) || chr(10) || '### Instruction:'
  || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || context
  || chr(10) || chr(10) || '### Response:' || chr(10) || reply || {D.q(fixed.EOS)} AS text
FROM triples""")
def alpaca_text(spark, sf):
    triples = I.exchanges(spark, sf).withColumn(
        "instruction", F.substring_index("question", "\n", 1)
    ).withColumn("context", F.expr("substr(question, length(instruction) + 2)"))
    text = chat.alpaca_prompt(F.col("instruction"), F.col("context"), F.col("reply"))
    return triples.select(*I.TURN_KEY, text.alias("text"))


@query("qa_conversations", f"""
WITH {D.EXCHANGES}
SELECT conv_id, turn, 'user,assistant' AS roles, question AS user_content,
       reply AS assistant_content FROM exchanges""")
def qa_conversations(spark, sf):
    messages = F.array(
        chat.message("user", F.col("question")), chat.message("assistant", F.col("reply"))
    )
    return I.exchanges(spark, sf).withColumn("conversations", messages).select(
        *I.TURN_KEY, _roles("conversations").alias("roles"),
        _content("conversations", 1).alias("user_content"),
        _content("conversations", 2).alias("assistant_content"),
    )


WRAPPED = (
    f"{D.q(fixed.WORK_START)} || {D.strip('reply')} || {D.q(fixed.WORK_END)} || "
    f"{D.q(fixed.SOLUTION_START)} || conv_id || {D.q(fixed.SOLUTION_END)}"
)


def _reasoning(spark, sf):
    """Exchanges as problem, tagged trace and numeric answer, rewritten to three turns."""
    trace = F.concat(F.lit("<think>\n"), "reply", F.lit("\n</think>\n"))
    final = tags.reasoning_answer(trace, F.col("conv_id").cast("string"))
    return I.exchanges(spark, sf).withColumn("messages", F.array(
        chat.message("system", F.lit(fixed.SYSTEM_PROMPT)),
        chat.message("user", F.col("question")), chat.message("assistant", final),
    ))


@query("reasoning_messages", f"""
WITH {D.EXCHANGES}
SELECT conv_id, turn, 'system,user,assistant' AS roles,
       {D.q(fixed.SYSTEM_PROMPT)} AS system_content, question AS user_content,
       {WRAPPED} AS assistant_content FROM exchanges""")
def reasoning_messages(spark, sf):
    return _reasoning(spark, sf).select(
        *I.TURN_KEY, _roles("messages").alias("roles"),
        _content("messages", 1).alias("system_content"),
        _content("messages", 2).alias("user_content"),
        _content("messages", 3).alias("assistant_content"),
    )


HASH_TEXT = (
    "CASE WHEN (conv_id + turn) % 5 = 0 THEN text ELSE text || '#### ' || conv_id || ' ' END"
)


def _hashed(spark, sf):
    keyed = F.concat("text", F.lit("#### "), F.col("conv_id").cast("string"), F.lit(" "))
    plain = (F.col("conv_id") + F.col("turn")) % 5 == 0
    return I.turns(spark, sf).withColumn(
        "answer_text", F.when(plain, F.col("text")).otherwise(keyed)
    )


HASHED = f"hashed AS (SELECT conv_id, turn, text, {HASH_TEXT} AS answer_text FROM conversations)"
SECOND_PIECE = "split_part(answer_text, '####', 2)"
ANSWER = f"CASE WHEN contains(answer_text, '####') THEN {D.strip(SECOND_PIECE)} END"


@query("system_prompts", f"""
WITH {HASHED}
SELECT conv_id, turn, 'system,user' AS roles, {D.q(fixed.SYSTEM_PROMPT)} AS system_content,
       text AS user_content, {ANSWER} AS answer FROM hashed""")
def system_prompts(spark, sf):
    prompts = _hashed(spark, sf).select(
        *I.TURN_KEY, chat.question_prompt(F.col("text")).alias("prompt"),
        tags.hash_answer(F.col("answer_text")).alias("answer"),
    )
    return prompts.select(
        *I.TURN_KEY, _roles("prompt").alias("roles"),
        _content("prompt", 1).alias("system_content"),
        _content("prompt", 2).alias("user_content"), "answer",
    )


@query("hash_answer", f"WITH {HASHED} SELECT conv_id, turn, {ANSWER} AS answer FROM hashed")
def hash_answer(spark, sf):
    answer = tags.hash_answer(F.col("answer_text"))
    return _hashed(spark, sf).select(*I.TURN_KEY, answer.alias("answer"))


def _spoken(speaker, value):
    return F.struct(F.lit(speaker).alias("from"), value.alias("value"))


@query("sharegpt_normalized", f"""
WITH {D.EXCHANGES}
SELECT conv_id, turn, 'system,user,assistant,tool' AS roles,
       'Be brief.|' || question || '|' || reply || '|' || turn AS contents FROM exchanges""")
def sharegpt_normalized(spark, sf):
    spoken = F.array(
        _spoken("system", F.lit("Be brief.")), _spoken("human", F.col("question")),
        _spoken("gpt", F.col("reply")), _spoken("tool", F.col("turn").cast("string")),
    )
    standard = I.exchanges(spark, sf).select(
        *I.TURN_KEY, chat.standardize(spoken).alias("messages")
    )
    return standard.select(
        *I.TURN_KEY, _roles("messages").alias("roles"),
        F.array_join(F.transform("messages", lambda m: m["content"]), "|").alias("contents"),
    )


@query("content_flattened", """
WITH parts AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS part,
         unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i
  FROM conversations)
SELECT conv_id, turn, coalesce(string_agg(part, '' ORDER BY i) FILTER (i % 3 <> 1), '') AS content
FROM parts GROUP BY conv_id, turn""")
def content_flattened(spark, sf):
    parts = F.transform(
        F.split("text", "\n"),
        lambda p, i: F.struct(
            F.when(i % 3 == 1, "image").otherwise("text").alias("type"), p.alias("text")
        ),
    )
    return I.turns(spark, sf).select(
        *I.TURN_KEY, chat.flatten_content(parts).alias("content")
    )


GEMMA_EXCHANGE = D.gemma(
    ("user", "(CASE WHEN conv_id % 2 = 0 THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END)"
             " || question"),
    ("assistant", "reply"),
)
GEMMA_PROMPT = f"{D.gemma(('user', 'question'))} || {D.q(fixed.TURN_START + 'model')} || chr(10)"


@query("chat_text_gemma", f"""
WITH {D.EXCHANGES}
SELECT conv_id, turn, {GEMMA_EXCHANGE} AS text, {GEMMA_PROMPT} AS prompt_text FROM exchanges""")
def chat_text_gemma(spark, sf):
    asked = chat.message("user", F.col("question"))
    replied = chat.message("assistant", F.col("reply"))
    with_system = F.array(chat.message("system", F.lit("Be brief.")), asked, replied)
    messages = F.when(F.col("conv_id") % 2 == 0, with_system).otherwise(F.array(asked, replied))
    return I.exchanges(spark, sf).withColumn("messages", messages).select(
        *I.TURN_KEY, chat.render_chat(F.col("messages")).alias("text"),
        chat.render_chat(F.array(asked), add_generation_prompt=True).alias("prompt_text"),
    )


@query("chat_text_reasoning", f"""
WITH {D.EXCHANGES}
SELECT conv_id, turn,
       {D.q(fixed.SYSTEM_PROMPT)} || {D.q(fixed.EOS)} || question || {WRAPPED} || {D.q(fixed.EOS)}
         AS text,
       {D.q(fixed.SYSTEM_PROMPT)} || {D.q(fixed.EOS)} || question || {D.q(fixed.WORK_START)}
         AS prompt_text FROM exchanges""")
def chat_text_reasoning(spark, sf):
    asked = F.array(chat.message("user", F.col("question")))
    return _reasoning(spark, sf).select(
        *I.TURN_KEY, chat.render_chat(F.col("messages"), "reasoning").alias("text"),
        chat.render_chat(asked, "reasoning", add_generation_prompt=True).alias("prompt_text"),
    )


@query("chat_turns_gemma", f"""
WITH kept AS ({D.GAPPED}),
numbered AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         first_value(role) OVER w AS first_role, first_value(text) OVER w AS first_text
  FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN k = 1 AND role = 'system'
    THEN {D.q(fixed.BOS)} || text || chr(10) || chr(10)
  ELSE CASE WHEN k = 1 OR (k = 2 AND first_role = 'system') THEN {D.q(fixed.BOS)} ELSE '' END
    || {D.q(fixed.TURN_START)} || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10)
    || CASE WHEN k = 2 AND first_role = 'system' THEN first_text || chr(10) || chr(10) ELSE '' END
    || text || {D.q(fixed.TURN_END)} || chr(10) END AS segment
FROM numbered WHERE NOT (k = 1 AND role = 'system' AND n > 1)""")
def chat_turns_gemma(spark, sf):
    return turns.render_turn_rows(I.gapped_turns(spark, sf))


_ENDING = f"{D.q(fixed.TURN_END)} || chr(10)"
_ASKED = f"{D.q(fixed.TURN_START + 'user')} || chr(10) || question || {_ENDING}"


def _blank(x):
    return f"repeat(' ', length({x}))"


@query("response_mask", f"""
WITH {D.EXCHANGES}
SELECT conv_id, turn,
       {_blank(f"{D.q(fixed.BOS)} || {_ASKED} || {D.q(fixed.TURN_START + 'model')} || chr(10)")}
         || reply || {_ENDING} || {_blank(_ASKED)} AS masked_text,
       length(reply || {_ENDING}) AS n_trained,
       list_sum(list_transform(string_split(reply || {_ENDING}, ''), lambda c: unicode(c)))::BIGINT
         AS trained_sum
FROM exchanges""")
def response_mask(spark, sf):
    asked, reply = F.col("question"), F.col("reply")
    text = chat.render_turns([("user", asked), ("assistant", reply), ("user", asked)])
    masked = I.exchanges(spark, sf).select(*I.TURN_KEY, text.alias("text"))
    labelled = masked.withColumn("labels", chat.response_labels(F.col("text")))
    trained = F.filter("labels", lambda x: x != fixed.IGNORED_LABEL)
    return labelled.select(
        *I.TURN_KEY, chat.response_mask(F.col("text")).alias("masked_text"),
        F.size(trained).alias("n_trained"),
        F.aggregate(trained, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("trained_sum"),
    )


@query("response_mask_ids", f"""
WITH {D.EXCHANGES}, parts AS (
  SELECT conv_id, turn, {D.q(fixed.BOS)} || {_ASKED} || {D.q(fixed.TURN_START + 'model')} || chr(10) AS head,
         reply || {_ENDING} AS said, {_ASKED} AS tail, 60 + (conv_id % 7) * 40 AS size FROM exchanges),
cut AS (
  SELECT conv_id, turn, length(head) AS a, length(head || said) AS b,
         least(size, length(head || said || tail)) AS n, left(head || said || tail, size) AS text FROM parts),
labelled AS (
  SELECT conv_id, turn, n, list_transform(range(n), lambda i: CASE
    WHEN n >= a AND i >= a AND (i < b OR n < b + {len(fixed.USER_HEADER)}) THEN unicode(text[i + 1])
    ELSE {fixed.IGNORED_LABEL} END) AS labels FROM cut)
SELECT conv_id, turn, array_to_string(labels, ',') AS labels,
       len(list_filter(labels, lambda x: x <> {fixed.IGNORED_LABEL})) AS n_trained FROM labelled""")
def response_mask_ids(spark, sf):
    """Token ids (code points) cut at lengths that end before, inside and after the markers."""
    asked, reply = F.col("question"), F.col("reply")
    text = chat.render_turns([("user", asked), ("assistant", reply), ("user", asked)])
    size = (60 + F.col("conv_id") % 7 * 40).cast("int")
    ids = I.exchanges(spark, sf).select(*I.TURN_KEY, chat.char_ids(F.substring(text, F.lit(1), size)).alias("ids"))
    user, model = ([ord(c) for c in header] for header in (fixed.USER_HEADER, fixed.MODEL_HEADER))
    labelled = ids.select(*I.TURN_KEY, chat.response_labels_ids(F.col("ids"), user, model).alias("labels"))
    return labelled.select(
        *I.TURN_KEY, F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"),
        F.size(F.filter("labels", lambda x: x != fixed.IGNORED_LABEL)).alias("n_trained"),
    )


@query("pad_truncate", f"""
WITH {D.PAIRS}, ids AS (
  SELECT doc_id, line_no, CASE WHEN kanji_text = '' THEN [] ELSE
    list_transform(string_split(left(kanji_text, 64), ''), lambda c: unicode(c)) END AS ids
  FROM pairs)
SELECT doc_id, line_no, array_to_string(list_resize(ids, 64, 0), ',') AS input_ids,
       repeat('1', len(ids)) || repeat('0', 64 - len(ids)) AS attention_mask FROM ids""")
def pad_truncate(spark, sf):
    padded = chat.pad_truncate_text(F.col("kanji_text"), 64)
    return I.pairs(spark, sf).select(*I.PAIR_KEY, padded.alias("p")).select(
        *I.PAIR_KEY, F.array_join(F.col("p.input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("p.attention_mask").cast("array<string>"), "").alias("attention_mask"),
    )


def _padded(order):
    return f"""
WITH {D.PAIRS}, ids AS (
  SELECT doc_id, line_no, CASE WHEN kanji_text = '' THEN [] ELSE
    list_transform(string_split(left(kanji_text, 96), ''), lambda c: unicode(c)) END AS ids FROM pairs),
batched AS (
  SELECT *, (row_number() OVER (ORDER BY {order}) - 1) // 8 AS batch_id FROM ids),
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS size FROM batched)
SELECT doc_id, line_no, batch_id, array_to_string(list_resize(ids, size, 0), ',') AS input_ids,
       repeat('1', len(ids)) || repeat('0', size - len(ids)) AS attention_mask FROM sized"""


def _padded_pairs(spark, sf, by_length):
    ids = I.pairs(spark, sf).select(*I.PAIR_KEY, chat.char_ids(F.substring("kanji_text", 1, 96)).alias("ids"))
    padded = batches.pad_to_longest(ids, "ids", 8, I.PAIR_KEY, by_length=by_length)
    return padded.select(
        *I.PAIR_KEY, "batch_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"),
    )


@query("pad_batch_longest", _padded("doc_id, line_no"))
def pad_batch_longest(spark, sf):
    return _padded_pairs(spark, sf, False)


@query("pad_batch_by_length", _padded("len(ids), doc_id, line_no"))
def pad_batch_by_length(spark, sf):
    """Batches of rows of like length, so little is padded."""
    return _padded_pairs(spark, sf, True)
