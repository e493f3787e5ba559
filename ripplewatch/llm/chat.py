"""Chat formatting: layouts recognised by a fingerprint of their field paths, rendered with reversible escapes.

A record is JSON text. The sorted set of its nested field paths (``messages[].role``) is hashed, and the hash selects
a declarative mapping that says where turns, roles and texts are. Rendering marks turns with control strings; whatever
looks like one inside a role or text is escaped with a backslash, so reading a rendering back gives exactly the turns.

Rows are one turn, or one whole record, each. They are sorted within their conversation and worked on as a stream, so
a conversation of any length needs no more memory than another.
"""

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
#: Control strings of this and of other common templates, and the escape itself.
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PIECE = re.compile(r"<\|start\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts: fields of a record, and how they become turns. ``each`` names a list with one turn in every element;
#: ``turns`` lists (role, fields), the non-empty fields joined by a blank line; ``role`` and ``text`` name fields.
LAYOUTS: list[tuple[list[str], dict]] = [
    (["role", "text"], {"role": "role", "text": "text"}),
    (["role", "content"], {"role": "role", "text": "content"}),
    (["messages[].role", "messages[].content"], {"each": "messages", "role": "role", "text": "content"}),
    (["conversations[].from", "conversations[].value"], {"each": "conversations", "role": "from", "text": "value"}),
    (["prompt", "completion"], {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]}),
    (["prompt", "response"], {"turns": [("user", ["prompt"]), ("assistant", ["response"])]}),
    (["question", "answer"], {"turns": [("user", ["question"]), ("assistant", ["answer"])]}),
    (["instruction", "output"], {"turns": [("user", ["instruction"]), ("assistant", ["output"])]}),
    (["instruction", "input", "output"], {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]}),
    (
        ["system", "prompt", "response"],
        {"turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    ),
]


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of the leaves of a JSON value; list elements share the path of their list with ``[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, prefix + "[]")}
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}


def _scalar(value) -> str | None:
    """A JSON scalar as text: null is empty, other scalars are spelled as in JSON; None for lists and objects.

    Halves of surrogate pairs, which JSON can spell but no text can hold, become U+FFFD.
    """
    if value is None:
        return ""
    if isinstance(value, (dict, list)):
        return None
    text = value if isinstance(value, str) else json.dumps(value)
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def turns_of(record: str | None) -> list[tuple[str, str]] | None:
    """(role, text) turns of a JSON record; None if it is no JSON object, its layout is unknown or it is nested too deep.

    Null roles and texts are empty, numbers and truth values are spelled as in JSON, and lone surrogates become U+FFFD.
    A record whose turns are not all objects, or in which a role or text is a list or an object, has an unknown layout.
    An empty list of turns gives no turns.
    """
    try:
        value = json.loads(record or "")
        paths = field_paths(value)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    mapping = MAPPINGS.get(fingerprint(paths))
    if mapping is None:
        lists = [k for k, v in value.items() if v == [] and len(value) == 1]
        return [] if lists and any(m.get("each") == lists[0] for m in MAPPINGS.values()) else None
    if "turns" in mapping:
        parts = [(role, [_scalar(value[f]) for f in fields]) for role, fields in mapping["turns"]]
    else:
        rows = value[mapping["each"]] if "each" in mapping else [value]
        if not all(isinstance(r, dict) for r in rows):
            return None
        pairs = [(_scalar(r.get(mapping["role"])), _scalar(r.get(mapping["text"]))) for r in rows]
        parts = [(None if role is None else ROLES.get(role, role), [text]) for role, text in pairs]
    if any(role is None or None in texts for role, texts in parts):
        return None
    return [(role, "\n\n".join(filter(None, texts))) for role, texts in parts]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:] if m[0] != "\\" else "\\\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendering of a turn, and the span of it that counts for the loss (empty unless an assistant speaks)."""
    head, body = START + escape(role) + TEXT, escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return head + body + END, *span


def read_back(piece: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    return [(unescape(role), unescape(text)) for role, text in _PIECE.findall(piece)]


def records_of_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, record of a table with one turn in each row (conv_id, turn, role, text)."""
    fields = (F.col(c).cast("string").alias(c) for c in ("role", "text"))
    turn = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn.alias("record"))


def format_chat(records: DataFrame) -> DataFrame:
    """conv_id, n, piece, loss_start, loss_end: the rendered turns of every conversation, in order.

    ``records`` has conv_id, turn and record. Rows of a conversation are ordered by turn, equal turns by record, null
    turns first; null conversation ids are one conversation. ``n`` numbers the turns of a conversation from 0. Records
    of an unknown layout give one row with a null piece. The pieces of a conversation, joined, are its rendering; the
    loss span counts code points of its piece.
    """
    names = ["conv_id", "n", "piece", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = records.select("conv_id", "turn", "record").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "record")

    def run(batches):
        now, n = object(), 0
        for batch in batches:
            made = []
            for conv, record in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if conv != now:
                    now, n = conv, 0
                turns = turns_of(record)
                if turns is None:
                    made.append((conv, n, None, 0, 0))
                    n += 1
                for role, text in turns or ():
                    made.append((conv, n, *render(role, text)))
                    n += 1
            columns = zip(*made, strict=True) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "conv_id long, n long, piece string, loss_start long, loss_end long")


def digests(pieces: DataFrame) -> DataFrame:
    """What reading the renderings back gives, for each conversation: turns and loss text as digests and lengths.

    ``pieces`` is as ``format_chat`` gives it or was stored. Null pieces hold no turns.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "n")

    def run(batches):
        now, open_ = None, False
        for batch in batches:
            made = []
            for conv, piece, low, high in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if not open_ or conv != now:
                    if open_:
                        made.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    now, open_, n, chars, size = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in read_back(piece or ""):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                masked = unescape((piece or "")[low:high])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                chars, size = chars + len(masked), size + len(piece or "")
            if made:
                yield _batch(made, kinds, names)
        if open_:
            yield _batch([(now, n, turns.hexdigest(), chars, loss.hexdigest(), size)], kinds, names)

    return rows.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
