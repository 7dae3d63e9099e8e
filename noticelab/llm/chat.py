"""Chat formatting by schema fingerprints.

A record is JSON in any known layout.  Its fingerprint hashes the sorted paths
of its nested fields; the fingerprint selects a declarative mapping that turns
the record into canonical turns (role, text); a template writes the turns as
one string with marks for turns and a loss mask over what assistants say.
Control strings inside roles and texts are broken up by an escape that `parse`
undoes exactly.

A conversation of any length is handled: rows are range partitioned by
(conversation, turn), a partition writes records of at most RECORD_TURNS turns,
and the parts of a conversation follow one another in its output.  The digest
of a long conversation is computed over a stream of its parts.

A record in no known layout is not formatted: it comes out with the paths of
its fields in the column `rejected`, and the others go on.

Cases: a null text or role is empty; rows that repeat a turn are turns each, in
the order of a hash of role and text; rows without a conv_id are one
conversation; an empty table gives the extra conversation alone; other columns,
whatever their names, are ignored.  A conversation's digest is one sequence by
its definition, so its parts pass through one task, one after another.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

RECORD_TURNS, RECORD_CHARS = 256, 1 << 20

#: Each layout: its field paths, and either the roles of single fields in order
#: or a list field with the names of its role and text and their role names.
LAYOUTS = {
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": "messages", "role": "role", "text": "content", "names": {}},
    "shared": {"paths": ["conversations[].from", "conversations[].value"], "list": "conversations", "role": "from", "text": "value", "names": {"human": "user", "gpt": "assistant"}},
    "completion": {"paths": ["completion", "prompt"], "fields": [["user", "prompt"], ["assistant", "completion"]]},
    "instruction": {"paths": ["input", "instruction", "output"], "fields": [["system", "instruction"], ["user", "input"], ["assistant", "output"]]},
    "instruction_only": {"paths": ["instruction", "output"], "fields": [["user", "instruction"], ["assistant", "output"]]},
    "question": {"paths": ["answer", "question"], "fields": [["user", "question"], ["assistant", "answer"]]},
    "system_prompt": {"paths": ["prompt", "response", "system"], "fields": [["system", "system"], ["user", "prompt"], ["assistant", "response"]]},
    "empty_messages": {"paths": ["messages[]"], "list": "messages", "role": "role", "text": "content", "names": {}},
}


class UnknownLayout(ValueError):
    """No mapping has this fingerprint."""


def paths(value, at: str = "") -> set[str]:
    """The paths of all nested fields; the elements of a list share the path []."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {at + "{}"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(found) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def registry() -> dict[str, dict]:
    return {fingerprint(m["paths"]): m for m in LAYOUTS.values()}


def canonical(record: dict, mappings: dict[str, dict]) -> list[tuple[str, str]]:
    """The turns of a record."""
    found = paths(record)
    mapping = mappings.get(fingerprint(found))
    if mapping is None:
        raise UnknownLayout(", ".join(sorted(found))[:500])
    text = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if "fields" in mapping:
        return [(role, text(record[name])) for role, name in mapping["fields"]]
    turns = record[mapping["list"]]
    names = mapping["names"]
    return [(names.get(t.get(mapping["role"]), text(t.get(mapping["role"]))), text(t.get(mapping["text"]))) for t in turns]


def escape(text: str, line: bool = False) -> str:
    """Without [ or < that a control string could begin with: each is followed by a backslash and a dash."""
    text = text.replace("\\", "\\\\").replace("[", "[\\-").replace("<", "<\\-")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"-": "", "n": "\n"}.get(m[1], m[1]), text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask."""
    parts, size, loss = [], 0, []
    for role, text in turns:
        body = escape(text)
        before, after = ("<s>", "</s>") if role == "assistant" else (f"[INST] {escape(role, True)}\n", "[/INST]")
        if role == "assistant":
            loss.append((size + len(before), size + len(before) + len(body)))
        parts += [before, body, after]
        size += len(before) + len(body) + len(after)
    return "".join(parts), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again."""
    out, at = [], 0
    for m in re.finditer(r"\[INST\] ([^\n]*)\n(.*?)\[/INST\]|<s>(.*?)</s>", formatted, re.S):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        out.append(("assistant", unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn ends at {len(formatted)}")
    return out


def as_record(turns: list[tuple[str, str]], odd: bool) -> dict:
    """A conversation in one of the layouts in which such data come."""
    roles = [r for r, _ in turns]
    if roles == ["user", "assistant"]:
        return {"prompt": turns[0][1], "completion": turns[1][1]}
    if roles == ["system", "user", "assistant"]:
        return {"instruction": turns[0][1], "input": turns[1][1], "output": turns[2][1]}
    if odd and set(roles) <= {"user", "assistant", "system"}:
        back = {"user": "human", "assistant": "gpt"}
        return {"conversations": [{"from": back.get(r, r), "value": t} for r, t in turns]}
    return {"messages": [{"role": r, "content": t} for r, t in turns]}


def records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as records: conv_id, part, record (JSON).
    The parts of a conversation ascend in the order of its turns."""
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ("conv_id", "turn", F.xxhash64("role", "text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", F.xxhash64("role", "text"), "role", "text")

    def built(frames):
        from pyspark import TaskContext

        part, key, turns, chars = TaskContext.get().partitionId() << 33, None, [], 0
        for pdf in frames:
            out = []
            for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"]):
                conv = None if conv is pd.NA else int(conv)
                if turns and (conv != key or len(turns) >= RECORD_TURNS or chars >= RECORD_CHARS):
                    out.append((key, part, json.dumps(as_record(turns, bool((key or 0) % 2)))))
                    part, turns, chars = part + 1, [], 0
                key = conv
                turns.append((role, text))
                chars += len(text)
            yield pd.DataFrame(out, columns=["conv_id", "part", "record"]).astype({"conv_id": "Int64"})
        if turns:
            yield pd.DataFrame(
                [(key, part, json.dumps(as_record(turns, bool((key or 0) % 2))))],
                columns=["conv_id", "part", "record"],
            ).astype({"conv_id": "Int64"})

    return _shared.map_frames(rows, built, "conv_id long, part long, record string")


def format_records(rows: DataFrame) -> DataFrame:
    """Records (conv_id, part, record) as formatted text with its loss mask, or why they are rejected."""

    def one(record: str, mappings: dict) -> tuple:
        try:
            formatted, loss = render(canonical(json.loads(record), mappings))
        except (UnknownLayout, ValueError) as reason:  # ValueError: not JSON
            return None, None, str(reason)
        return formatted, [{"start": a, "end": b} for a, b in loss], None

    def formatted(frames):
        mappings = registry()
        for pdf in frames:
            got = [one(r, mappings) for r in pdf["record"]]
            yield pd.DataFrame(
                {
                    "conv_id": pdf["conv_id"],
                    "part": pdf["part"],
                    "formatted": [t for t, _, _ in got],
                    "loss": [m for _, m, _ in got],
                    "rejected": [r for _, _, r in got],
                }
            )

    return _shared.map_frames(
        rows,
        formatted,
        "conv_id long, part long, formatted string, loss array<struct<start: long, end: long>>, rejected string",
    )


def read_back(output: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, parsed from the output, part after part."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(frames):
        key, state = None, None

        def done():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for pdf in frames:
            out = []
            for conv, text, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"]):
                conv = None if conv is pd.NA else int(conv)
                if state is not None and conv != key:
                    out.append(done())
                    state = None
                if state is None:
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                state[0] += len(turns)
                state[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                masked = "".join(unescape(text[m["start"] : m["end"]]) for m in loss)
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([done()], columns=names).astype({"conv_id": "Int64"})

    rows = (
        output.where("rejected is null")
        .select("conv_id", "part", "formatted", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
    )
    return _shared.map_frames(
        rows,
        read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(_shared.written(format_records(records(rows)), "chat"))
