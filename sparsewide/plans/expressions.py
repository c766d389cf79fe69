"""Rewrites the dialect's expressions and query blocks to Spark SQL text.

A statement becomes tokens, and tokens become primaries, operators and keywords. What a construct means can depend on the types of its operands (`/`, `*`, `=`,
AVG, PERCENTILE, CAST); such a construct stays a numbered slot until Catalyst has told the types: the statement is analysed, never run, with the operands of
the innermost open slots carrying their number, and the types are read from the analysed plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.scalar import MACROS

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|@?[A-Za-z_]\w*|:[A-Za-z_]\w*|@\d+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|\.\d+|<=>|<=|>=|!=|<>|==|\|\||<<|>>|->|\s+|.", re.S)
#: Words that end an operand.
KEYWORDS = set(
    "SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET AS ON USING JOIN INNER LEFT RIGHT FULL OUTER CROSS SEMI ANTI NATURAL LATERAL VIEW UNION INTERSECT EXCEPT AND OR NOT IN IS "
    "BETWEEN LIKE ILIKE RLIKE REGEXP GLOB MATCH ESCAPE WHEN THEN ELSE ASC DESC NULLS FIRST LAST EXISTS WITH TOP TOPN SET VALUES INTO OVER PARTITION ROWS RANGE PRECEDING FOLLOWING UNBOUNDED CURRENT "
    "FILTER WITHIN ROLLUP CUBE SETS GROUPING INTERVAL TABLESAMPLE WINDOW".split()
)
_ADDITIVE = {"+", "-", "||", "&", "|", "^", "<<", ">>"}
#: The dialect's type names that Spark spells otherwise.
TYPES = {"int": "bigint", "integer": "bigint", "id": "bigint", "bool": "boolean", "idset": "array<bigint>", "stringset": "array<string>", "string": "string", "timestamp": "timestamp"}
_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
#: Aggregates that don't ask for the order of their rows, and what those that do become when the rows come the other way round.
_UNORDERED = set(
    "COUNT COUNT_IF SUM TRY_SUM MIN MAX AVG MEAN TRY_AVG VAR VARIANCE VAR_POP VAR_SAMP STD STDDEV STDDEV_POP STDDEV_SAMP SKEWNESS KURTOSIS CORR COVAR_POP COVAR_SAMP "
    "BOOL_AND BOOL_OR EVERY ANY SOME BIT_AND BIT_OR BIT_XOR APPROX_COUNT_DISTINCT".split()
)
_MIRRORED = {"FIRST": "LAST", "FIRST_VALUE": "LAST_VALUE", "LAST": "FIRST", "LAST_VALUE": "FIRST_VALUE", "ANY_VALUE": "LAST"}


class DialectError(ValueError):
    pass


def tokens(text: str) -> list[str]:
    """The statement's tokens; comments and white space are single blanks."""
    return [" " if t.isspace() or t.startswith(("--", "/*")) else t for t in _TOKEN.findall(text)]


def _scale(kind: str) -> int | None:
    """The scale of a decimal or integral type, None for others."""
    m = re.match(r"decimal\(\d+,(\d+)\)", kind)
    return int(m[1]) if m else 0 if kind in _INTEGRAL else None


def group(toks: list[str], at: int) -> tuple[list[str], int]:
    """The tokens inside the bracket at `at`, and the place after its end."""
    ends, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for k in range(at, len(toks)):
        depth += toks[k] in ends
        depth -= toks[k] in ends.values()
        if depth == 0:
            return toks[at + 1 : k], k + 1
    raise DialectError("unclosed bracket")


def arguments(toks: list[str]) -> list[list[str]]:
    """Splits at the commas outside brackets."""
    out, depth = [[]], 0
    for t in toks:
        depth += t in ("(", "[", "{")
        depth -= t in (")", "]", "}")
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [a for a in out if any(t != " " for t in a)]


def _place(words: list[str], *what: str) -> int | None:
    """Where the words stand, outside brackets."""
    depth = 0
    for k, t in enumerate(words):
        depth += t in ("(", "[", "{")
        depth -= t in (")", "]", "}")
        if depth == 0 and tuple(x.upper() for x in words[k : k + len(what)]) == what:
            return k
    return None


def _descending(key: list[str]) -> list[str]:
    """The key of ORDER BY the other way round; Spark's defaults for nulls turn with it."""
    key, nulls = list(key), []
    if len(key) > 2 and key[-2].upper() == "NULLS":
        nulls = ["NULLS", "LAST" if key[-1].upper() == "FIRST" else "FIRST"]
        key = key[:-2]
    down = len(key) > 1 and key[-1].upper() == "DESC"
    key = key[:-1] if len(key) > 1 and key[-1].upper() in ("ASC", "DESC") else key
    return [*key, "ASC" if down else "DESC", *nulls]


def linear_frame(name: str, window: list[str], *, plain_call: bool = True) -> tuple[str, list[str]]:
    """The same function and window without a frame that runs from the current row to the partition's end.

    Spark computes such a frame anew for each row, which takes the square of the partition's rows; from the start on it adds row by row. LAST of all rows up to
    the end is that of the whole partition; else the rows are sorted the other way round. `plain_call`: the function takes nulls like other values. Functions that
    aren't known to allow this stay as they are.
    """
    words = [t for t in window if t != " "]
    frame = next((k for kind in ("ROWS", "RANGE") if (k := _place(words, kind, "BETWEEN")) is not None), None)
    if frame is None or [t.upper() for t in words[-3:]] != ["AND", "UNBOUNDED", "FOLLOWING"]:
        return name, window
    up, since = name.upper(), words[frame + 2 : -3]
    began = since[-1].upper() if since else ""
    if up not in _UNORDERED | _MIRRORED.keys() or began not in ("ROW", "PRECEDING", "FOLLOWING") or since[0].upper() == "UNBOUNDED":
        return name, window
    whole = [words[frame], "BETWEEN", "UNBOUNDED", "PRECEDING", "AND"]
    if up in ("LAST", "LAST_VALUE") and plain_call and began != "FOLLOWING":
        return name, [*words[:frame], *whole, "UNBOUNDED", "FOLLOWING"]
    order = _place(words, "ORDER", "BY")
    keys = [] if order is None else [_descending(key) for key in arguments(words[order + 2 : frame])]
    turned = [t for k, key in enumerate(keys) for t in ([","] if k else ["ORDER", "BY"]) + key]
    upto = [*since[:-1], {"PRECEDING": "FOLLOWING", "FOLLOWING": "PRECEDING"}.get(began, since[-1])]
    return _MIRRORED.get(up, name), [*words[: frame if order is None else order], *turned, *whole, *upto]


class Rewriter:
    """Rewrites statements; `functions` are macros of the session, `sets` tells whether set columns may occur."""

    def __init__(self, functions: dict[str, Callable] | None = None, *, sets: bool = False, reference_like: bool = False):
        self.macros = MACROS | (functions or {})
        self.sets, self.reference_like = sets, reference_like
        self.slots: list[tuple] = []  # (operator, operands)
        self.types: dict[int, list[str]] = {}
        self.windows: list[dict[str, list[str]]] = []  # the named windows of the blocks around

    # query blocks

    def query(self, toks: list[str]) -> str:
        """A query: TOP becomes a LIMIT of its own SELECT block."""
        out, block, at, depth = [], [], 0, 0
        while at < len(toks):
            t = toks[at].upper()
            if depth == 0 and t in ("UNION", "INTERSECT", "EXCEPT"):
                out += [self._block(block, more=True), toks[at]]
                block, at = [], at + 1
                if at + 1 < len(toks) and toks[at] == " " and toks[at + 1].upper() in ("ALL", "DISTINCT"):
                    out.append(toks[at + 1])
                    at += 2
                continue
            depth += t in ("(", "[", "{")
            depth -= t in (")", "]", "}")
            block.append(toks[at])
            at += 1
        return " ".join([*out, self._block(block, more=bool(out))])

    def _block(self, toks: list[str], more: bool) -> str:
        top, out, at, depth = None, [], 0, 0
        while at < len(toks):
            t = toks[at].upper()
            if depth == 0 and t == "LIMIT" and top is not None:
                raise DialectError("TOP and LIMIT exclude each other")
            if depth == 0 and t in ("TOP", "TOPN") and any(x.upper() in ("SELECT", "DISTINCT") for x in [x for x in out if x != " "][-1:]):
                at += 1
                while toks[at] == " ":
                    at += 1
                if toks[at] == "(":
                    inner, at = group(toks, at)
                    number = "".join(inner).strip()
                else:
                    number, at = toks[at], at + 1
                if not number.isdigit():
                    raise DialectError("TOP takes a number")
                top = number
                continue
            depth += t in ("(", "[", "{")
            depth -= t in (")", "]", "}")
            out.append(toks[at])
            at += 1
        self.windows.append(self._named_windows(out))
        text = self.expression(self._hinted(out))
        self.windows.pop()
        if top is None:
            return text
        return f"({text} LIMIT {top})" if more else f"{text} LIMIT {top}"

    @staticmethod
    def _named_windows(toks: list[str]) -> dict[str, list[str]]:
        """The block's `WINDOW w AS (...), ...`."""
        words, found = [t for t in toks if t != " "], {}
        at = _place(words, "WINDOW")
        while at is not None and at + 3 < len(words) and words[at + 2].upper() == "AS" and words[at + 3] == "(":
            found[words[at + 1].lower()], end = group(words, at + 3)
            at = end if end < len(words) and words[end] == "," else None
        return found

    @staticmethod
    def _hinted(toks: list[str]) -> list[str]:
        """`t [AS] a WITH (flatten(c))` becomes a table with a row for each member of c."""
        words, out = [k for k, t in enumerate(toks) if t != " "], list(toks)
        for n, k in enumerate(words):
            if toks[k].upper() != "WITH" or n + 2 >= len(words) or toks[words[n + 1]] != "(" or toks[words[n + 2]].lower() != "flatten":
                continue
            _, end = group(toks, words[n + 1])
            column = toks[words[n + 4]]
            alias = table = n - 1
            if toks[words[n - 2]].upper() == "AS":
                table = n - 3
            elif toks[words[n - 2]].upper() not in ("FROM", "JOIN", ","):
                table = n - 2
            name, called = toks[words[table]], toks[words[alias]]
            made = tokens(f"(SELECT * EXCEPT ({column}), explode({column}) AS {column} FROM {name}) AS {called}")
            return Rewriter._hinted(out[: words[table]] + made + out[end:])
        return out

    # expressions

    def expression(self, toks: list[str]) -> str:
        items = self._equalities(self._products(self._items(toks)))
        return " ".join(text for _, text in items)

    def slot(self, operator: str, *operands: str) -> str:
        if (operator, operands) not in self.slots:
            self.slots.append((operator, operands))
        return f"\x00{self.slots.index((operator, operands))}\x00"

    def _items(self, toks: list[str]) -> list[tuple[str, str]]:
        """(kind, text): p primary, o operator, k keyword or comma."""
        out: list[tuple[str, str]] = []
        at = 0
        sign = ""

        def put(text: str):
            nonlocal sign
            out.append(("p", sign + text))
            sign = ""

        while at < len(toks):
            t = toks[at]
            up = t.upper()
            after = at + 1
            while after < len(toks) and toks[after] == " ":
                after += 1
            follows = toks[after] if after < len(toks) else ""
            primed = bool(out) and out[-1][0] == "p" and not sign
            if t == " ":
                at += 1
            elif t == "(":
                inner, at = group(toks, at)
                first = next((x.upper() for x in inner if x not in (" ", "(")), "")
                put(f"({self.query(inner) if first in ('SELECT', 'WITH') else self._list(inner)})")
            elif t == "[":
                inner, at = group(toks, at)
                if primed:
                    out[-1] = ("p", f"{out[-1][1]}[{self.expression(inner)}]")
                else:
                    put(f"array({self._list(inner)})")
            elif t == "{":
                inner, at = group(toks, at)
                put(f"named_struct({', '.join(f"'col{k}', {self.expression(a)}" for k, a in enumerate(arguments(inner), 1))})")
            elif t == "*" and not primed:
                put("*")
                at += 1
            elif t in ("-", "+", "~", "!") and not primed:
                sign += "~" if t == "!" else f" {t}" if t == "-" and sign.endswith("-") else t
                at += 1
            elif up == "CASE":
                depth, end = 0, at
                while end < len(toks):
                    depth += toks[end].upper() == "CASE"
                    depth -= toks[end].upper() == "END"
                    end += 1
                    if depth == 0:
                        break
                put(f"CASE {self.expression(toks[at + 1 : end - 1])} END")
                at = end
            elif up in ("DATE", "TIMESTAMP") and follows.startswith("'"):
                put(f"{t} {follows}")
                at = after + 1
            elif up in ("LIKE", "GLOB", "MATCH", "REGEXP") and follows:
                at, kind = self._pattern(up, follows, after, at)
                out.append(("k", kind))
            elif up in KEYWORDS and not (follows == "(" and up in ("LEFT", "RIGHT", "FIRST", "LAST", "GROUPING")) and not (out and out[-1][1].endswith(".")):
                out.append(("k", t))
                at += 1
            elif re.match(r"@?[A-Za-z_]|[`\"]", t):
                at = self._name(toks, at, put)
            elif re.match(r"[\d.:']|@\d", t) and t != ".":
                put(f"_c{t[1:]}" if t[0] == "@" else t)
                at += 1
            elif t in (",", ";"):
                out.append(("k", t))
                at += 1
            else:
                out.append(("o", t))
                at += 1
        return out

    def _list(self, toks: list[str]) -> str:
        return ", ".join(self.expression(a) for a in arguments(toks))

    def _pattern(self, word: str, pattern: str, after: int, at: int) -> tuple[int, str]:
        if word == "LIKE" and not self.reference_like:
            return at + 1, "ILIKE"
        if word in ("REGEXP", "MATCH"):
            return at + 1, "RLIKE"
        if not pattern.startswith("'"):
            raise DialectError(f"{word} takes a literal")
        p = pattern[1:-1]
        if word == "LIKE":  # % is any text and _ one or more characters; the rest is taken as a regular expression
            p = "(?is)^" + p.replace("%", ".*").replace("_", ".+") + "$"
        else:
            p = "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-" else re.escape(c)) for c in p).replace("[!", "[^") + "$"
        return after + 1, "RLIKE '" + p.replace("\\", "\\\\") + "'"

    def _name(self, toks: list[str], at: int, put) -> int:
        """A name with its qualifiers, or a call."""
        name, at = toks[at], at + 1
        while at + 1 < len(toks) and toks[at] == ".":
            name, at = f"{name}.{toks[at + 1]}", at + 2
        open_ = at
        while open_ < len(toks) and toks[open_] == " ":
            open_ += 1
        if open_ >= len(toks) or toks[open_] != "(":
            put(f":{name[1:]}" if name[0] == "@" else name)
            return at
        inner, at = group(toks, open_)
        suffix = ""
        while True:  # FILTER (...), IGNORE NULLS, OVER (...) or OVER w, WITHIN GROUP (...)
            k = at
            while k < len(toks) and toks[k] == " ":
                k += 1
            word = toks[k].upper() if k < len(toks) else ""
            if word not in ("FILTER", "IGNORE", "RESPECT", "OVER", "WITHIN"):
                break
            b = k + 1
            while b < len(toks) and toks[b] != "(" and (toks[b] == " " or toks[b].upper() == "GROUP"):
                b += 1
            if word in ("IGNORE", "RESPECT"):
                if b >= len(toks) or toks[b].upper() != "NULLS":
                    break
                suffix, at = f"{suffix} {word} NULLS", b + 1
                continue
            windows = self.windows[-1] if self.windows else {}
            if word == "OVER" and b < len(toks) and toks[b].lower() in windows:
                body, at = windows[toks[b].lower()], b + 1
            elif b >= len(toks) or toks[b] != "(":
                break
            else:
                body, at = group(toks, b)
            if word == "OVER":
                body = windows.get("".join(body).strip().lower(), body)
                name, body = linear_frame(name, body, plain_call=len(arguments(inner)) == 1 and "IGNORE NULLS" not in suffix)
            suffix += f" {'WITHIN GROUP' if word == 'WITHIN' else word} ({self.expression(body)})"
        put(self._call(name, inner, suffix))
        return at

    def _call(self, name: str, inner: list[str], suffix: str) -> str:
        up = name.upper()
        if up == "CAST":
            k = max(n for n, t in enumerate(inner) if t.upper() == "AS")
            return self.slot("CAST", self.expression(inner[:k]), "".join(inner[k + 1 :]).strip().lower())
        distinct = next((t for t in inner if t != " "), "").upper() == "DISTINCT"
        args = [self.expression(a) for a in arguments(inner[inner.index(next(t for t in inner if t != " ")) + 1 :] if distinct else inner)]
        once = "DISTINCT " if distinct else ""
        if up == "AVG" and len(args) == 1:
            return self.slot("AVG", args[0], once, suffix)
        if up == "VAR" and len(args) == 1:
            return f"CAST(floor(var_pop({once}{args[0]}){suffix} * 1000000) / 1000000 AS DECIMAL(38,6))"
        if up == "CORR" and len(args) == 2:
            c = f"corr({args[0]}, {args[1]}){suffix}"
            return f"CAST(signum({c}) * floor(abs({c}) * 1000000) / 1000000 AS DECIMAL(38,6))"
        if up == "PERCENTILE" and len(args) == 2:
            if not re.fullmatch(r"\d+(\.\d+)?", args[1]) or not 0 <= float(args[1]) <= 100:
                raise DialectError("PERCENTILE takes a number from 0 to 100")
            return self.slot("PERCENTILE", args[0], args[1], suffix)
        if up in self.macros and not suffix:
            return self.macros[up](*args)
        if first := next((t.upper() for t in inner if t not in (" ", "(")), "") in ("SELECT", "WITH") and first:
            return f"{name}({self.query(inner)}){suffix}"
        return f"{name}({once}{', '.join(args)}){suffix}"

    def _products(self, items: list[tuple[str, str]]) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for item in items:
            if item[0] == "p" and len(out) >= 2 and out[-1] in (("o", "*"), ("o", "/"), ("o", "%")) and out[-2][0] == "p":
                op, left = out.pop()[1], out.pop()[1]
                out.append(("p", f"({left} % {item[1]})" if op == "%" else self.slot(op, left, item[1])))
            else:
                out.append(item)
        return out

    def _equalities(self, items: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """Equality of sets: the left side contains all members of the right one."""
        if not self.sets:
            return items
        inside = lambda x: x[0] == "p" or (x[0] == "o" and x[1] in _ADDITIVE)
        out, at = [], 0
        while at < len(items):
            if items[at] in (("o", "="), ("o", "=="), ("o", "!="), ("o", "<>")) and out and inside(out[-1]):
                lo = len(out)
                while lo and inside(out[lo - 1]):
                    lo -= 1
                hi = at + 1
                while hi < len(items) and inside(items[hi]):
                    hi += 1
                left, right = (" ".join(t for _, t in part) for part in (out[lo:], items[at + 1 : hi]))
                if left and right:
                    out[lo:] = [("p", self.slot("=" if items[at][1] in ("=", "==") else "!=", left, right))]
                    at = hi
                    continue
            out.append(items[at])
            at += 1
        return out

    # slots

    def text(self, text: str) -> str:
        """The text with slots filled: final where the types are known, carrying their number or plain where they aren't."""
        return re.sub("\x00(\\d+)\x00", lambda m: self._filled(int(m[1])), text)

    def open(self) -> bool:
        return len(self.types) < len(self.slots)

    def _filled(self, n: int) -> str:
        operator, operands = self.slots[n]
        nested = {int(x) for o in operands for x in re.findall("\x00(\\d+)\x00", o)}
        args = [self.text(o) for o in operands]
        if n in self.types:
            return final(operator, args, self.types[n])
        if nested <= self.types.keys():
            known = args[:2] if operator in ("*", "/", "=", "!=") else args[:1]
            kinds = ", ".join(f"typeof({a})" for a in known)
            args[0] = f"if(array_contains(array('#{n}'), concat_ws('|', {kinds})), {args[0]}, {args[0]})"
        return plain(operator, args)

    def learn(self, plan) -> None:
        """Reads the operands' types from an analysed plan of the JVM."""
        before = len(self.types)
        _walk(plan, self.types)
        if len(self.types) == before:
            raise DialectError("types of operands not found")


def _walk(node, types: dict) -> None:
    """Goes through plans, their expressions and subqueries, for array_contains(array('#n'), concat_ws('|', typeof(x), ...))."""
    todo = [node]
    while todo:
        x = todo.pop()
        name = x.getClass().getSimpleName()
        if name == "ArrayContains" and x.left().getClass().getSimpleName() == "CreateArray" and x.left().children().size() == 1:
            mark = x.left().children().apply(0).toString()
            if mark[:1] == "#" and mark[1:].isdigit():
                kinds = x.right().children()
                types[int(mark[1:])] = [kinds.apply(k).children().apply(0).dataType().simpleString() for k in range(1, kinds.size())]
        if hasattr_java(x, "expressions"):
            seq = x.expressions()
            todo += [seq.apply(k) for k in range(seq.size())]
        if name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            todo.append(x.plan())
        if hasattr_java(x, "innerChildren"):
            seq = x.innerChildren()
            todo += [seq.apply(k) for k in range(seq.size()) if hasattr_java(seq.apply(k), "children")]
        seq = x.children()
        todo += [seq.apply(k) for k in range(seq.size())]


_METHODS: dict[str, set] = {}


def hasattr_java(x, name: str) -> bool:
    kind = x.getClass()
    key = kind.getName()
    if key not in _METHODS:
        _METHODS[key] = {m.getName() for m in kind.getMethods()}
    return name in _METHODS[key]


def plain(operator: str, a: list[str]) -> str:
    """The construct before its types are known."""
    if operator in ("*", "/", "=", "!="):
        return f"({a[0]} {operator} {a[1]})"
    if operator == "AVG":
        return f"avg({a[1]}{a[0]}){a[2]}"
    if operator == "PERCENTILE":
        return f"max({a[0]}){a[2]}"
    return f"CAST({a[0]} AS {spark_type(a[1])})"


def spark_type(name: str) -> str:
    if m := re.fullmatch(r"decimal\((\d+)\)", name):  # one number is the scale
        return f"decimal(38,{m[1]})"
    return TYPES.get(name, name)


def final(operator: str, a: list[str], kinds: list[str]) -> str:
    scales = [_scale(k) for k in kinds]
    decimal = any(k.startswith("decimal") for k in kinds) and None not in scales
    if operator in ("=", "!="):
        if all(k.startswith("array") for k in kinds):
            return f"{'NOT ' if operator == '!=' else ''}forall({a[1]}, _m -> array_contains({a[0]}, _m))"
        return f"({a[0]} {operator} {a[1]})"
    if operator == "*":
        return f"CAST(floor({a[0]} * {a[1]}, {max(scales)}) AS DECIMAL(38,{max(scales)}))" if decimal else f"({a[0]} * {a[1]})"
    if operator == "/":
        if all(k in _INTEGRAL for k in kinds):
            return f"({a[0]} div {a[1]})"
        if not decimal:
            return f"({a[0]} / {a[1]})"
        s = max(scales)  # floor division of whole units, exact; the sign goes to the dividend
        n = f"CAST({a[0]} * CAST(signum({a[1]}) AS INT) * {10**s} * {10**s} AS DECIMAL(38,0))"
        d = f"CAST(abs({a[1]}) * {10**s} AS DECIMAL(38,0))"
        return f"CAST(CAST(({n} - pmod({n}, {d})) div {d} AS DECIMAL(38,0)) / {10**s} AS DECIMAL(38,{s}))"
    if operator == "AVG":
        if scales[0] is None:
            return f"avg({a[1]}{a[0]}){a[2]}"
        s = scales[0]
        units = f"CAST(sum({a[1]}CAST({a[0]} * {10**s} AS DECIMAL(38,0))){a[2]} * {10 ** max(0, 4 - s)} AS DECIMAL(38,0))"
        return f"CAST(({units} div (count({a[1]}{a[0]}){a[2]} * {10 ** max(0, s - 4)})) / 10000 AS DECIMAL(38,4))"
    if operator == "PERCENTILE":
        p = f"percentile_disc({float(a[1]) / 100!r}) WITHIN GROUP (ORDER BY "
        if kinds[0].startswith("timestamp"):
            return f"CAST(timestamp_micros(CAST({p}unix_micros(CAST({a[0]} AS TIMESTAMP))){a[2]} AS BIGINT)) AS {kinds[0]})"
        return f"CAST({p}{a[0]}){a[2]} AS {kinds[0]})"
    return _cast(a[0], spark_type(a[1]), kinds[0])


def _cast(x: str, to: str, kind: str) -> str:
    m = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", to)
    if to == "boolean" and kind in _INTEGRAL:
        return f"({x} > 0)"
    if to == "timestamp" and kind in _INTEGRAL:
        return f"timestamp_seconds({x})"
    if to == "string" and kind.startswith("timestamp"):
        return f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    if to == "string" and kind.startswith("array"):
        return f"to_json(array_sort({x}))"
    if m and kind.startswith("decimal") and _scale(kind) > int(m[2]):
        return f"CAST(if({x} = floor({x}, {m[2]}), {x}, raise_error('the scale of {to} is too small')) AS {to})"
    if m and kind == "string":
        return f"CAST(if(length(regexp_extract({x}, '[.]([0-9]*?)0*$', 1)) > {m[2]}, raise_error('the scale of {to} is too small'), {x}) AS {to})"
    return f"CAST({x} AS {to})"
