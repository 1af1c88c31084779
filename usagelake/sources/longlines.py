"""Lines too long to hold: whether they are sound JSON objects that can't matter, told in bounded memory.

A scanner with a stack goes over the line chunk by chunk, checks the whole grammar and remembers five short strings at most. A
line is irrelevant only if it is an object without flaw whose type says so, and no discriminating key stands there twice.
"""

from __future__ import annotations

import json
import re

#: Nesting beyond this isn't followed, and a longer string discriminates nothing.
MOST_DEPTH, MOST_STRING = 10_000, 512
#: Types of records that no harness's usage needs.
IRRELEVANT = {
    "codex": {"type": ("response_item",), "payload.type": ("agent_message", "agent_reasoning", "user_message", "exec_command_begin", "exec_command_end", "task_complete", "turn_aborted")},
    "pi": {"type": ("model_change", "thinking_level_change", "custom", "compaction", "branch_summary", "label"), "message.role": ("user", "toolResult")},
    "claude-code": {"type": ("user", "system", "progress", "queue-operation", "file-history-snapshot", "summary")},
}
#: The type under which a second key decides.
OUTER = {"payload.type": "event_msg", "message.role": "message"}
_KEYS = {"": ("type", "payload", "message"), "payload": ("type",), "message": ("role",)}

_SPACE, _PLAIN, _DIGITS = re.compile(rb"[ \t\n\r]*"), re.compile(rb'[^"\\\x00-\x1f]*'), re.compile(rb"[0-9]*")
_ESCAPE = re.compile(rb'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
_HALF = re.compile(rb"\\(?:u[0-9a-fA-F]{0,3})?\Z")  # an escape that the next chunk goes on with
_LITERALS = {ord("t"): b"true", ord("f"): b"false", ord("n"): b"null"}
#: Numbers: what may follow in each state, and the states in which one may end.
_NUMBER = {"sign": {"0": "zero", "d": "whole"}, "zero": {".": "point", "e": "power"}, "whole": {"0": "whole", "d": "whole", ".": "point", "e": "power"}, "point": {"0": "part", "d": "part"}, "part": {"0": "part", "d": "part", "e": "power"}, "power": {"s": "signed", "0": "digits", "d": "digits"}, "signed": {"0": "digits", "d": "digits"}, "digits": {"0": "digits", "d": "digits"}}
_WHOLE_NUMBER = ("zero", "whole", "part", "digits")
_CLASS = {ord("0"): "0", **{ord(c): "d" for c in "123456789"}, ord("."): ".", ord("e"): "e", ord("E"): "e", ord("+"): "s", ord("-"): "s"}


class LineJudge:
    """feed() chunks, then ask. States between tokens: object (its opening is due), first_key, key, colon, value, first_value, next, end."""

    def __init__(self) -> None:
        self.flawed, self.ambiguous = False, False
        self.values: dict[str, str] = {}
        self._seen: set[str] = set()
        self._expect, self._token, self._rest = "object", "", b""
        self._stack: list[str | None] = []  # paths of open objects ("?": none that matters), None for arrays
        self._path, self._text, self._number = "", bytearray(), ""

    def feed(self, data: bytes) -> None:
        if self.flawed:
            return
        buffer, at = self._rest + data, 0
        while at < len(buffer) and not self.flawed:
            if self._token == "string":
                step = self._string(buffer, at)
            elif self._token == "number":
                step = self._digits(buffer, at)
            elif self._token:
                step = self._literal(buffer, at)
            else:
                at = _SPACE.match(buffer, at).end()  # type: ignore[union-attr]
                step = self._between(buffer[at], at) if at < len(buffer) else at
            if step is None:  # an escape goes on in the next chunk
                break
            at = step
        self._rest = b"" if self.flawed else buffer[at:]

    def sound(self) -> bool:
        """Whether what has been fed is one whole object."""
        return not self.flawed and self._expect == "end" and not self._rest.strip(b" \t\r\n")

    def irrelevant(self, harness: str) -> bool:
        if not self.sound() or self.ambiguous:
            return False
        for path, names in IRRELEVANT[harness].items():
            if self.values.get(path) in names and (path == "type" or self.values.get("type") == OUTER[path]):
                return True
        return False

    def _flaw(self, at: int) -> int:
        self.flawed = True
        return at

    def _string(self, buffer: bytes, at: int) -> int | None:
        end = _PLAIN.match(buffer, at).end()  # type: ignore[union-attr]
        self._remember(buffer, at, end)
        if end == len(buffer):
            return end
        if buffer[end] == ord('"'):
            return self._ended(end + 1)
        if buffer[end] != ord("\\"):
            return self._flaw(end)
        found = _ESCAPE.match(buffer, end)
        if not found:
            if len(buffer) - end < 6 and _HALF.match(buffer, end):
                self._rest = b""
                return None if at == end else end
            return self._flaw(end)
        self._remember(buffer, end, found.end())
        return found.end()

    def _remember(self, buffer: bytes, a: int, b: int) -> None:
        if len(self._text) <= MOST_STRING:
            self._text += buffer[a : min(b, a + MOST_STRING + 1)]

    def _ended(self, at: int) -> int:
        self._token, short = "", len(self._text) + 2 <= MOST_STRING
        text = json.loads(b'"' + bytes(self._text) + b'"') if short and _is_utf8(self._text) else ""
        if self._expect in ("key", "first_key"):
            parent = self._stack[-1]
            path = f"{parent}.{text}".lstrip(".") if text in _KEYS.get(parent or "", ()) and parent is not None else "?"
            if path != "?":
                self.ambiguous |= path in self._seen
                self._seen.add(path)
            self._path, self._expect = path, "colon"
        else:
            if self._path != "?":
                self.values[self._path] = text
            self._expect = "next"
        return at

    def _digits(self, buffer: bytes, at: int) -> int:
        while at < len(buffer):
            if self._number in ("whole", "part", "digits"):
                at = _DIGITS.match(buffer, at).end()  # type: ignore[union-attr]
                if at == len(buffer):
                    break
            following = _NUMBER[self._number].get(_CLASS.get(buffer[at], ""))
            if not following:
                if self._number not in _WHOLE_NUMBER:
                    return self._flaw(at)
                self._token, self._expect = "", "next"
                return at
            self._number, at = following, at + 1
        return at

    def _literal(self, buffer: bytes, at: int) -> int:
        due = _LITERALS[ord(self._token)][len(self._text) :]
        got = buffer[at : at + len(due)]
        if not due.startswith(got):
            return self._flaw(at)
        self._text += got
        if len(got) == len(due):
            self._token, self._expect = "", "next"
        return at + len(got)

    def _between(self, c: int, at: int) -> int:
        due, char = self._expect, chr(c)
        if due == "object" and char == "{":
            return self._open("", at)
        if due in ("key", "first_key") and char == '"' or due in ("value", "first_value") and char == '"':
            self._token, self._text = "string", bytearray()
            return at + 1
        if due == "colon" and char == ":":
            self._expect = "value"
            return at + 1
        if due in ("first_key", "next") and char == "}" and self._stack[-1] is not None or due in ("first_value", "next") and char == "]" and self._stack[-1] is None:
            self._stack.pop()
            self._expect = "next" if self._stack else "end"
            return at + 1
        if due == "next" and char == ",":
            self._expect, self._path = ("value", "?") if self._stack[-1] is None else ("key", "?")
            return at + 1
        if due in ("value", "first_value"):
            if char == "{":
                return self._open(self._path, at)
            if char == "[":
                return self._open(None, at)
            if c in _LITERALS:
                self._token, self._text = char, bytearray(char.encode())
                return at + 1
            if char == "-" or char.isdigit():
                self._token, self._number = "number", "sign" if char == "-" else "zero" if char == "0" else "whole"
                return at + 1
        return self._flaw(at)

    def _open(self, path: str | None, at: int) -> int:
        if len(self._stack) >= MOST_DEPTH:
            return self._flaw(at)
        self._stack.append(path)
        self._expect, self._path = ("first_value", "?") if path is None else ("first_key", "?")
        return at + 1


def _is_utf8(text: bytearray) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True
