r"""Chat formatting with typed content parts.

A message's content is a list of typed parts; plain text is one part. A visitor
turns each part into text: text stays, an image, audio or document becomes an
ordered placeholder, its reference is recorded, and the tokens it will expand to
are counted. The template marks each turn; control strings inside texts and roles
get one backslash after their opening character, which reading back takes away
again, whatever backslashes were there before.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TAILS = r"\||s>|/s>|INST\]|/INST\]|<SYS>|</SYS>"
_CONTROL = re.compile(rf"(<|\[)(?=\\*(?:{_TAILS}))")
_ESCAPED = re.compile(rf"(<|\[)\\(?=\\*(?:{_TAILS}))")
_PLACE = re.compile(r"<\|(\w+):(\d+)\|>")
_MESSAGE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)

#: One content part; `ref` names an attachment, the numbers say how large it is.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    """Marks control strings so that none stands in a text as one."""
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of a conversation in order; placeholders are numbered through all its turns.

    Texts side by side are escaped as one, so that no control string forms where they meet.
    """

    image_tile: int = 28
    audio_tokens_a_second: float = 25.0
    document_tokens_a_page: int = 768
    attachments: list[dict] = field(default_factory=list)
    done: list[str] = field(default_factory=list)
    held: list[str] = field(default_factory=list)

    def flatten(self, content, turn: int) -> str:
        """A turn's content as escaped text; null content and null parts are empty."""
        for part in [{"text": content}] if isinstance(content, str) else content or []:
            if part is not None:
                self.visit(part, turn)
        self._close()
        out, self.done = "".join(self.done), []
        return out

    def visit(self, part: dict, turn: int) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part, turn)

    def visit_text(self, part: dict, turn: int) -> None:
        self.held.append(part.get("text") or "")

    def visit_image(self, part: dict, turn: int) -> None:
        tiles = math.ceil((part.get("width") or 0) / self.image_tile) * math.ceil((part.get("height") or 0) / self.image_tile)
        self._attach("image", part, turn, max(1, tiles))

    def visit_audio(self, part: dict, turn: int) -> None:
        self._attach("audio", part, turn, max(1, math.ceil((part.get("seconds") or 0) * self.audio_tokens_a_second)))

    def visit_document(self, part: dict, turn: int) -> None:
        self._attach("document", part, turn, max(1, (part.get("pages") or 0) * self.document_tokens_a_page))

    def visit_other(self, part: dict, turn: int) -> None:
        """An unknown type keeps its text, and its reference as an attachment of one token, if it has any."""
        if part.get("ref"):
            self._attach(re.sub(r"\W", "_", part["type"]), part, turn, 1)
        self.visit_text(part, turn)

    def _close(self) -> None:
        self.done.append(escape("".join(self.held)))
        self.held = []

    def _attach(self, kind: str, part: dict, turn: int, tokens: int) -> None:
        self._close()
        n = len(self.attachments)
        self.attachments.append({"n": n, "turn": turn, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self.done.append(f"<|{kind}:{n}|>")


ATTACHMENT = "struct<n:int,turn:int,kind:string,ref:string,tokens:int>"
FORMATTED = f"conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>, attachments array<{ATTACHMENT}>, expanded_tokens long"


def format_conversations(rows: DataFrame, content: str = "text", trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: formatted text, code point spans under the loss mask, attachments, expanded tokens.

    Rows are (conv_id, turn, role, content); content is a string or an array of PART. Turns go by `turn`,
    null first, equal ones by role and text; null role and content are empty; rows without conv_id are
    one conversation; repeated rows are turns of their own; other columns are left out. A conversation's
    rows stream through one task in order, which holds its text: a conversation is one row of the result.
    """
    kind = dict(rows.dtypes)[content]
    used = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col(content).alias("content"))
    own = F.col("content") if kind == "string" else F.array_join(F.transform("content", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    order = [F.coalesce(own, F.lit("")), *([] if kind == "string" else [F.to_json("content")])]
    used = used.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", *order)
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("attachments", pa.list_(pa.struct([("n", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))), ("expanded_tokens", pa.int64())])

    def close(conv, out, spans, flat):
        return {"conv_id": conv, "formatted": "".join(out), "loss_spans": spans, "attachments": flat.attachments, "expanded_tokens": sum(a["tokens"] for a in flat.attachments)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out, spans, flat, at, turn, begun = None, [], [], Flattener(), 0, 0, False
        for batch in batches:
            done = []
            for i, role, body in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "content")), strict=True):
                if not begun or i != conv:
                    if begun:
                        done.append(close(conv, out, spans, flat))
                    conv, out, spans, flat, at, turn, begun = i, [], [], Flattener(), 0, 0, True
                head, text = f"{TURN}{escape(role)}{TEXT}", flat.flatten(body, turn)
                start = at + len(head)
                if role in trained_roles:
                    spans.append({"start": start, "end": start + len(text)})
                out += head, text, END
                at, turn = start + len(text) + len(END), turn + 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if begun:
            yield pa.RecordBatch.from_pylist([close(conv, out, spans, flat)], schema)

    return used.mapInArrow(run, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _MESSAGE.findall(formatted)]


def read_parts(text: str, attachments: list[dict]) -> list[dict]:
    """The typed parts of one turn's formatted text, with what its placeholders stand for; empty texts are left out."""
    out, at = [], 0
    for place in _PLACE.finditer(text):
        out += [{"type": "text", "text": unescape(text[at : place.start()])}, {"type": place[1], "ref": attachments[int(place[2])]["ref"]}]
        at = place.end()
    return [p for p in [*out, {"type": "text", "text": unescape(text[at:])}] if p.get("text") != ""]


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans, attached in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "attachments")), strict=True):
                turns, turned, loss, chars = read_turns(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    turned.update(f"{role}\n{body}\n".encode())
                for span in spans:
                    body = unescape(text[span["start"] : span["end"]])
                    loss.update(body.encode())
                    chars += len(body)
                out.append((conv, len(turns), turned.hexdigest(), chars, loss.hexdigest(), len(text), len(attached)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long")


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments"]
