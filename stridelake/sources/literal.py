"""Python literals as array headers hold them, read without evaluating anything."""

from __future__ import annotations

import ast
from typing import Any

from ..errors import Errors, NdError

_CONSTANTS = (str, bytes, int, float, bool, type(None))


def parse_literal(text: str) -> Any:
    """Value of one dict, list, tuple, set, string, number, bool or None; NdError 205 for anything else."""
    try:
        return _value(ast.parse(text.strip(), mode="eval").body)
    except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError) as e:
        raise NdError(Errors.header_parsing_error, str(e)[:120]) from None


def _value(node: ast.expr) -> Any:
    match node:
        case ast.Constant(value) if isinstance(value, _CONSTANTS):
            return value
        case ast.UnaryOp(op=ast.USub() | ast.UAdd() as op, operand=ast.Constant(value)) if isinstance(value, (int, float)) and not isinstance(value, bool):
            return -value if isinstance(op, ast.USub) else value
        case ast.Tuple(elts):
            return tuple(map(_value, elts))
        case ast.List(elts):
            return list(map(_value, elts))
        case ast.Set(elts):
            return set(map(_value, elts))
        case ast.Dict(keys, values) if None not in keys:
            return {_value(k): _value(v) for k, v in zip(keys, values)}
    raise ValueError(f"no literal: {type(node).__name__}")


def token_spans(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, begin, end) of the tokens of a literal, for tools that show where a header goes wrong."""
    import io
    import tokenize

    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in (tokenize.NEWLINE, tokenize.NL, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT):
                continue
            kind = {tokenize.STRING: "string", tokenize.NUMBER: "number", tokenize.OP: "punctuation"}.get(t.type, "name")
            kind = {"True": "bool", "False": "bool", "None": "none"}.get(t.string, kind)
            out.append((kind, t.string, starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        out.append(("unknown", "", len(text), len(text)))
    return out
