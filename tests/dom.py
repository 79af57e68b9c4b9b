"""A second evaluator, over json.loads() alone: what demands mean without spans or an exact reader. For tests only."""

import json
from decimal import Decimal


def load(text):
    return json.loads(text, parse_int=Decimal, parse_float=Decimal)


def row(element, fields):
    return {f: element[f] for f in fields if f in element} if isinstance(element, dict) else {}


def holds(element, p):
    op = type(p).__name__
    if not isinstance(element, dict):
        return False
    if op == "And":
        return holds(element, p.left) and holds(element, p.right)
    if op == "Or":
        return holds(element, p.left) or holds(element, p.right)
    if op == "Not":
        return not holds(element, p.inner)
    want = Decimal(p.value.spelling) if hasattr(p.value, "spelling") else p.value
    there = p.field in element
    got = element.get(p.field)
    same = there and type(got) is type(want) and got == want
    if p.op == "eq":
        return same
    if p.op == "ne":
        return not same
    if not there or not isinstance(got, Decimal) or not isinstance(want, Decimal):
        return False
    return {"gt": got > want, "lt": got < want, "ge": got >= want, "le": got <= want}[p.op]


def go(value, path):
    for name in path:
        if not isinstance(value, dict) or name not in value:
            return None
        value = value[name]
    return value


def project_each(items, path, fields):
    out = []
    for e in items:
        found = go(e, path) if path else e
        if path and isinstance(found, list):
            out += [row(x, fields) for x in found] or [{}]
        else:
            out.append(row(found, fields))
    return out
