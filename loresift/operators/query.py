"""Boolean queries: lexing, precedence, and the algebra tree they stand for. Driver-side, no Spark."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.stem import stem

OPERATORS = {"or": 1, "and": 2, "not": 3}


@dataclass(frozen=True)
class Leaf:
    term: str


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


def lex(query: str) -> list[str]:
    """Tokens in lower case; parentheses stand alone; signs at a word's ends are dropped."""
    spaced = query.replace("(", " ( ").replace(")", " ) ")
    result = []
    for word in spaced.split():
        if word in "()":
            result.append(word)
            continue
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        keep = [k for k, c in enumerate(low) if c.isascii() and (c.isalnum() or c == "'")]
        if keep:
            result.append(low[keep[0] : keep[-1] + 1])
    return result


def postfix(tokens: list[str]) -> list[str]:
    """Reverse Polish order: NOT before AND before OR, NOT to the right. Unmatched parentheses vanish."""
    out, held = [], []
    for token in tokens:
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        elif token in OPERATORS:
            rank = OPERATORS[token]
            while held and held[-1] != "(" and (OPERATORS[held[-1]] > rank or (OPERATORS[held[-1]] == rank and token != "not")):
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    out.extend(t for t in reversed(held) if t != "(")
    return out


def tree(query: str):
    """The set algebra of a query, or None if it stands for nothing.

    NOT is a difference where a left operand exists, else a complement; AND and OR without two
    operands do nothing; of operands side by side the last one counts.
    """
    stack: list[object] = []
    for token in postfix(lex(query)):
        if token == "not":
            if len(stack) >= 2:
                right = stack.pop()
                stack.append(Minus(stack.pop(), right))
            elif stack:
                stack.append(Minus(Everything(), stack.pop()))
        elif token in ("and", "or"):
            if len(stack) >= 2:
                right = stack.pop()
                stack.append((And if token == "and" else Or)(stack.pop(), right))
        else:
            stack.append(Leaf(stem(token)))
    return stack[-1] if stack else None


def query_terms(query: str) -> list[str]:
    """Distinct stems of a query in order, negated and ignored ones included: all of them score."""
    return list(dict.fromkeys(stem(t) for t in lex(query) if t not in OPERATORS and t not in "()"))


def fold(node, leaf, everything, both, either, minus):
    """Evaluate a tree with the given meanings; None gives None."""
    if node is None:
        return None
    if isinstance(node, Leaf):
        return leaf(node.term)
    if isinstance(node, Everything):
        return everything
    left, right = (fold(n, leaf, everything, both, either, minus) for n in (node.left, node.right))
    return {And: both, Or: either, Minus: minus}[type(node)](left, right)


def holds_without_terms(node) -> bool:
    """Whether a document without any query term can match."""
    return bool(fold(node, lambda _: False, True, lambda a, b: a and b, lambda a, b: a or b, lambda a, b: a and not b))
