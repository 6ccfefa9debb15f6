"""Chat formatting by schema fingerprints.

A record is JSON in any of several layouts. Its fingerprint is a hash of its nested field paths, as far as some layout
names them; the fingerprint selects a declarative mapping, which yields canonical turns (role, text). The template marks
each turn and escapes control strings inside roles and texts so that the turns can be read back from the output.

Defined results: null text and null roles count as empty; a record that is null, no JSON, nested too deeply to be read or
of no known layout has layout null, no turns and an empty output; lone surrogates become U+FFFD; turns with equal numbers are
ordered by role, then text, null before all; a null conversation identifier is a conversation of its own; repeated rows are
repeated turns; other fields of a record and other columns change nothing; an empty table gives no rows. A conversation is one
output string, so its turns meet in one row: one conversation may have at most what a row of Spark holds, 2 GB.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import prepare, trimmed

#: Roles of other layouts under their canonical names.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

#: Layouts: ``each`` names a list with a role and a text field (both optional ones map to empty); its text may be a list of
#: parts, of which ``part`` names the text, or stand in the field ``otherwise`` where its own is empty. ``fields`` name single
#: turns in order; ``join`` puts a field after another one's text. ``first`` is a field whose text, if any, precedes all.
LAYOUTS = {
    "messages": {"each": "messages", "role": "role", "text": "content"},
    "message_texts": {"each": "messages", "role": "role", "text": "text"},
    "message_either": {"each": "messages", "role": "role", "text": "content", "otherwise": "text"},
    "message_parts": {"each": "messages", "role": "role", "part": "content[].text"},
    "message_mixed": {"each": "messages", "role": "role", "text": "content", "part": "content[].text"},
    "system_messages": {"each": "messages", "role": "role", "text": "content", "first": ("system", "system")},
    "conversation_messages": {"each": "conversations", "role": "role", "text": "content"},
    "from_value": {"each": "conversations", "role": "from", "text": "value"},
    "system_from_value": {"each": "conversations", "role": "from", "text": "value", "first": ("system", "system")},
    "turns": {"each": "turns", "role": "speaker", "text": "utterance"},
    "prompt_completion": {"fields": [("user", "prompt"), ("assistant", "completion")]},
    "prompt_response": {"fields": [("user", "prompt"), ("assistant", "response")]},
    "system_prompt_response": {"fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "question_answer": {"fields": [("user", "question"), ("assistant", "answer")]},
    "instruction": {"fields": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"fields": [("user", "instruction"), ("assistant", "output")], "join": {"instruction": "input"}},
    "system_instruction_input": {
        "fields": [("system", "system"), ("user", "instruction"), ("assistant", "output")], "join": {"instruction": "input"},
    },
}


def mapping_paths(layout: dict) -> set[str]:
    found = {layout["first"][1]} if "first" in layout else set()
    if "each" in layout:
        return found | {f"{layout['each']}[].{layout[k]}" for k in ("role", "text", "part", "otherwise") if k in layout}
    return found | {f for _, f in layout["fields"]} | set(layout.get("join", {}).values())


KNOWN = set().union(*map(mapping_paths, LAYOUTS.values()))
#: Nothing below so many steps is part of a layout.
DEPTH = 1 + max(p.count(".") + p.count("[]") for p in KNOWN)


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths & KNOWN)).encode()).hexdigest()


MAPPINGS = {fingerprint(mapping_paths(layout)): name for name, layout in LAYOUTS.items()}


def field_paths(value) -> set[str]:
    """Paths of a record's fields, with [] for list items, as far down as layouts reach.

    Points and brackets in a key are escaped, so that a key that spells a path isn't that path.
    """
    found, left = set(), [(value, "", 0)]
    while left:
        value, at, depth = left.pop()
        if depth > DEPTH or not isinstance(value, dict | list):
            found.add(at)
        elif isinstance(value, list):
            left += [(v, f"{at}[]", depth + 1) for v in value]
        else:
            for key, v in value.items():
                name = re.sub(r"([\\.\[])", r"\\\1", key)
                left.append((v, f"{at}.{name}" if at else name, depth + 1))
    return found


def _text(value) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def _message(item: dict, layout: dict) -> str:
    """The text of a list's item: of its field, of the parts of its field, or of another one if that is empty."""
    value = item.get(layout.get("text", layout.get("part", "").partition("[")[0]))
    if "part" in layout and isinstance(value, list):
        name = layout["part"].rpartition(".")[2]
        return "".join(_text(p.get(name) if isinstance(p, dict) else p) for p in value)
    return _text(value) or _text(item.get(layout.get("otherwise")))


def canonical(record: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
    """(layout, fingerprint, turns) of a JSON record."""
    try:
        value = json.loads(record or "")
        if not isinstance(value, dict):
            return None, None, []
        print_ = fingerprint(field_paths(value))
        name = MAPPINGS.get(print_)
        if name is None:
            return None, print_, []
        return name, print_, _turns(value, LAYOUTS[name])
    except (ValueError, RecursionError):  # no JSON, or nested more deeply than the reader goes
        return None, None, []


def _turns(value: dict, layout: dict) -> list[tuple[str, str]]:
    turns = []
    if "first" in layout and (text := _text(value.get(layout["first"][1]))):
        turns.append((layout["first"][0], text))
    if "each" in layout:
        items = [x for x in value[layout["each"]] if isinstance(x, dict)]
        turns += [(_text(x.get(layout["role"])), _message(x, layout)) for x in items]
    else:
        for role, field in layout["fields"]:
            text, more = _text(value.get(field)), _text(value.get(layout.get("join", {}).get(field)))
            turns.append((role, f"{text}\n\n{more}" if more else text))
    return [(ROLES.get(r.lower(), r), t) for r, t in turns]


#: The template: a turn is OPEN, role, line feed, text, CLOSE, line feed.
OPEN, CLOSE = "<s>", "</s>"
CONTROL = re.compile(r"([<\[])(/?s>|/?INST\]|</?SYS>>)")


def escape(text: str) -> str:
    """No control string is left; a backslash stands doubled, a single one breaks a control string."""
    return CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", "\\": "\\"}.get(m[1], ""), role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the spans under the loss mask (code points): the assistant's texts."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        turns.append((unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


def loss_text(formatted: str, starts: list[int], ends: list[int]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))


SCHEMA = (
    "layout string, fingerprint string, formatted string, loss_starts array<long>, loss_ends array<long>, "
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _row(record: str | None) -> tuple:
    layout, print_, turns = canonical(record)
    formatted, starts, ends = render(turns)
    back, loss = read_back(formatted), loss_text(formatted, starts, ends)
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest()
    loss_digest = hashlib.sha256(loss.encode()).hexdigest()
    return layout, print_, formatted, starts, ends, len(back), digest, len(loss), loss_digest, len(formatted)


def format_records(records: DataFrame, *, id_col: str, record_col: str) -> DataFrame:
    """One row per record: id, layout, fingerprint, formatted, the loss mask's spans, and digests read back from them."""
    prepare(records.sparkSession)
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches):
        types = [pa.string()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.int64(), pa.string()] * 2 + [pa.int64()]
        labels = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [_row(r) for r in batch.column(1).to_pylist()]
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *labels])

    chosen = records.select(F.col(id_col).alias("id"), F.col(record_col).cast("string").alias("record"))
    return chosen.mapInArrow(trimmed(run), f"id {kind}, {SCHEMA}")


#: Layouts in which ``records_of_turns`` can write a conversation whatever its roles.
LISTS = ("messages", "message_texts", "message_parts", "conversation_messages", "from_value", "turns")


def _written(turns: Column, name: str) -> Column:
    """Turns (role, content) as a record of a layout with a list."""
    layout = LAYOUTS[name]

    def item(t: Column) -> Column:
        if "part" in layout:
            part = F.struct(F.lit("text").alias("type"), t["content"].alias(layout["part"].rpartition(".")[2]))
            return F.struct(t["role"].alias(layout["role"]), F.array(part).alias(layout["part"].partition("[")[0]))
        return F.struct(t["role"].alias(layout["role"]), t["content"].alias(layout["text"]))

    return F.to_json(F.struct(F.transform(turns, item).alias(layout["each"])))


def records_of_turns(
    rows: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    layouts: tuple[str, ...] = ("messages",),
) -> DataFrame:
    """Records from a table with a row per turn; a hash of the identifier chooses each one's layout among ``layouts``."""
    turn = F.struct(
        F.col(turn_col).alias("n"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
    )
    grouped = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chosen = F.pmod(F.xxhash64("id"), F.lit(len(layouts)))
    record = _written(F.col("turns"), layouts[0])
    for i, name in enumerate(layouts[1:], 1):
        record = F.when(chosen == i, _written(F.col("turns"), name)).otherwise(record)
    return grouped.select("id", record.alias("record"))
