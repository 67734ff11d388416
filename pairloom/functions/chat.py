"""Messages, prompts, chat templates, loss masks and fixed-length token arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import fixed

ROLE_NAMES = {"human": "user", "gpt": "assistant", "system": "system"}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def conversation(source: Column, target: Column) -> Column:
    """Two turns: the fixed instruction with the source, then the target."""
    return F.array(message("user", instruction(source)), message("assistant", target))


def instruction(source: Column) -> Column:
    return F.concat(F.lit(fixed.INSTRUCTION), source)


def conversion_prompt(source: Column) -> Column:
    return F.array(message("user", instruction(source)))


def seq2seq_prompt(source: Column, target: Column | None = None) -> Column:
    """Training text, or the inference form that ends where the target would start."""
    parts = [
        F.lit(f"{fixed.SEQ2SEQ_INSTRUCTION}\n{fixed.SEQ2SEQ_INPUT}"), source,
        F.lit(f"\n{fixed.SEQ2SEQ_OUTPUT}"),
    ]
    return F.concat(*parts, target) if target is not None else F.concat(*parts)


def alpaca_prompt(
    instruct: Column, context: Column, output: Column, eos: str = fixed.EOS
) -> Column:
    return F.concat(
        F.lit(f"{fixed.ALPACA_HEAD}\n\n{fixed.ALPACA_INSTRUCTION}\n"), instruct,
        F.lit(f"\n\n{fixed.ALPACA_INPUT}\n"), context,
        F.lit(f"\n\n{fixed.ALPACA_RESPONSE}\n"), output, F.lit(eos),
    )


def question_prompt(question: Column, system: str = fixed.SYSTEM_PROMPT) -> Column:
    return F.array(message("system", F.lit(system)), message("user", question))


def standardize(turns: Column) -> Column:
    """``{from, value}`` turns to ``{role, content}``; unknown speakers keep their name."""

    def one(turn):
        role = turn["from"]
        for name, standard in ROLE_NAMES.items():
            role = F.when(turn["from"] == name, standard).otherwise(role)
        return F.struct(role.alias("role"), turn["value"].alias("content"))

    return F.transform(turns, one)


def flatten_content(parts: Column) -> Column:
    """Text parts of a multi-part content, joined; other parts carry no text."""
    texts = F.filter(parts, lambda p: p["type"] == "text")
    return F.array_join(F.transform(texts, lambda p: p["text"]), "")


def _header(role: Column) -> Column:
    name = F.when(role == "assistant", "model").otherwise(role)
    return F.concat(F.lit(fixed.TURN_START), name, F.lit("\n"))


def chat_turn(role: Column, content: Column) -> Column:
    """One turn with its markers."""
    return F.concat(_header(role), content, F.lit(f"{fixed.TURN_END}\n"))


def render_chat(
    messages: Column, template: str = "gemma", add_generation_prompt: bool = False,
    eos: str = fixed.EOS, system: str = fixed.SYSTEM_PROMPT,
) -> Column:
    """Training text of a message array.

    ``gemma`` puts a system message in front of the first turn's content. ``reasoning``
    opens with the system message, or ``system`` where there is none.
    """
    first = F.try_element_at(messages, F.lit(1))
    has_system = first["role"] == "system"
    turns = F.when(has_system, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    if template == "gemma":
        prefix = F.when(has_system, F.concat(first["content"], F.lit("\n\n"))).otherwise("")
        body = F.transform(
            turns,
            lambda m, i: chat_turn(
                m["role"],
                F.concat(F.when(i == 0, prefix).otherwise(""), m["content"]),
            ),
        )
        head, tail = F.lit(fixed.BOS), fixed.MODEL_HEADER
    elif template == "reasoning":
        body = F.transform(
            turns,
            lambda m: F.when(m["role"] == "user", m["content"])
            .when(m["role"] == "assistant", F.concat(m["content"], F.lit(eos)))
            .otherwise(""),
        )
        head = F.concat(
            F.when(has_system, first["content"]).otherwise(system), F.lit(eos)
        )
        tail = fixed.WORK_START
    else:
        raise ValueError(f"unknown chat template: {template}")
    text = F.concat(head, F.array_join(body, ""))
    return F.concat(text, F.lit(tail)) if add_generation_prompt else text


def render_turns(turns: Sequence[tuple[str, Column]]) -> Column:
    """``gemma`` text for a fixed sequence of turns.

    Same text as ``render_chat`` on the matching array, as one ``concat`` in generated
    code; use it where the shape of the conversation is known.
    """
    return F.concat(
        F.lit(fixed.BOS), *[chat_turn(F.lit(role), content) for role, content in turns]
    )


def render_pair(source: Column, target: Column) -> Column:
    return render_turns([("user", instruction(source)), ("assistant", target)])


def _response_parts(text: Column) -> Column:
    """Text cut at user headers; each part as (masked, trained) strings."""

    def cut(part, i):
        at = F.instr(part, fixed.MODEL_HEADER)
        size = F.when(at > 0, at + F.lit(len(fixed.MODEL_HEADER) - 1)).otherwise(F.length(part))
        header = F.when(i > 0, fixed.USER_HEADER).otherwise("")
        return F.struct(
            F.concat(header, F.substring(part, F.lit(1), size)).alias("masked"),
            F.substring(part, size + 1, F.length(part)).alias("trained"),
        )

    return F.transform(F.split(text, fixed.USER_HEADER), cut)


def response_mask(text: Column) -> Column:
    """Rendered text with everything but the responses as blanks."""
    return F.array_join(
        F.transform(
            _response_parts(text),
            lambda p: F.concat(F.repeat(F.lit(" "), F.length(p["masked"])), p["trained"]),
        ),
        "",
    )


def char_ids(text: Column) -> Column:
    """Code points as token ids; the empty text has none."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c))


def response_labels(text: Column) -> Column:
    """Label per code point: its id inside a response, the ignored label elsewhere."""
    return F.flatten(
        F.transform(
            _response_parts(text),
            lambda p: F.concat(
                F.array_repeat(F.lit(fixed.IGNORED_LABEL), F.length(p["masked"])),
                char_ids(p["trained"]),
            ),
        )
    )


def _spelt_ids(ids: Column) -> Column:
    """Ids as ``,1;,2;``: a run of ids is then a substring that starts and ends with whole ids."""
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), F.coalesce(i.cast("string"), F.lit("")), F.lit(";"))), "")


def response_labels_ids(ids: Column, instruction: Sequence[int], response: Sequence[int]) -> Column:
    """Label per token id: the id inside a response, the ignored label elsewhere.

    As ``response_labels``, on token ids: a response begins after the first ``response`` run of
    ids behind an ``instruction`` run (or behind the start) and ends before the next
    ``instruction`` run or with the array. A run that truncation has cut is no run. Null ids
    match nothing and have null labels inside a response; a null array has null labels.
    """
    if not instruction or not response:
        raise ValueError("both runs of marker ids must have ids")
    asked, said = ("".join(f",{i};" for i in run) for run in (instruction, response))

    def label(part: Column, i: Column) -> Column:
        at = F.instr(part, said)
        size = F.when(at > 0, at + F.lit(len(said) - 1)).otherwise(F.length(part))
        masked = F.concat(F.when(i > 0, asked).otherwise(""), F.substring(part, F.lit(1), size))
        return F.concat(
            F.regexp_replace(masked, "[^;]*;", f",{fixed.IGNORED_LABEL};"), F.substring(part, size + 1, F.length(part))
        )

    spelt = F.array_join(F.transform(F.split(_spelt_ids(ids), asked), label), "")
    labels = F.transform(F.split(F.substring(spelt, F.lit(2), F.length(spelt) - 2), ";,"), lambda x: x.try_cast("int"))
    return F.when(F.size(ids) == 0, F.array().cast("array<int>")).when(ids.isNotNull(), labels)


def pad_truncate_text(text: Column, size: int, pad_id: int = 0, side: str = "right") -> Column:
    """``pad_truncate`` of a text's code points; only what is kept is cut into characters."""
    return pad_truncate(char_ids(F.substring(text, 1, size)), size, pad_id, side)


def pad_truncate(ids: Column, size: int | Column, pad_id: int = 0, side: str = "right") -> Column:
    """Struct of ``input_ids`` cut or padded to ``size`` and its ``attention_mask``."""
    size = size if isinstance(size, Column) else F.lit(size)
    kept = F.slice(ids, F.lit(1), size)
    missing = size - F.size(kept)
    pads, zeros = F.array_repeat(F.lit(pad_id), missing), F.array_repeat(F.lit(0), missing)
    ones = F.array_repeat(F.lit(1), F.size(kept))
    if side == "right":
        both = F.concat(kept, pads), F.concat(ones, zeros)
    elif side == "left":
        both = F.concat(pads, kept), F.concat(zeros, ones)
    else:
        raise ValueError(f"unknown padding side: {side}")
    return F.struct(both[0].alias("input_ids"), both[1].alias("attention_mask"))
