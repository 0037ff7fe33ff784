"""Arithmetic over metric aliases: + - * /, parentheses, numbers, names. Division by zero gives null."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from gnomon.errors import MetricsError


def names(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(n.id for n in ast.walk(_parsed(text)) if isinstance(n, ast.Name)))


def column(text: str) -> Column:
    return _column(_parsed(text))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _parsed(text: str) -> ast.expr:
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise MetricsError(f"not a formula: {text!r}") from e


def _column(node: ast.expr) -> Column:
    match node:
        case ast.Name(id=name):
            return F.col(f"`{name}`")
        case ast.Constant(value=int() | float() as value):
            return F.lit(value)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            return -_column(x)
        case ast.BinOp(left=a, op=ast.Add(), right=b):
            return _column(a) + _column(b)
        case ast.BinOp(left=a, op=ast.Sub(), right=b):
            return _column(a) - _column(b)
        case ast.BinOp(left=a, op=ast.Mult(), right=b):
            return _column(a) * _column(b)
        case ast.BinOp(left=a, op=ast.Div(), right=b):
            return divide(_column(a), _column(b))
    raise MetricsError(f"a formula has +, -, *, /, numbers and metric names only: {ast.unparse(node)}")
