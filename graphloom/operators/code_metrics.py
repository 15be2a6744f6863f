"""X14 counts of one source: branches and functions of Python and of JavaScript and TypeScript."""

from __future__ import annotations

import ast
import re

_PY_NOISE = re.compile(r"#[^\n]*|[rRbBfFuU]{0,2}(?:'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)", re.S)


def python_counts(source: str) -> tuple[int, int]:
    """(branches, functions). Comprehensions count by their guards, assert and else not at all.

    A source with an error is counted by its words, outside strings and comments.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        code = _PY_NOISE.sub(" ", source)
        branches = re.findall(r"\b(?:if|elif|while|except|and|or)\b|^[ \t]*(?:async[ \t]+)?for\b|^[ \t]*case\b(?=.*:[ \t]*$)", code, re.M)
        return len(branches), len(re.findall(r"^[ \t]*(?:async[ \t]+)?def\b", code, re.M))
    branches = functions = 0
    for n in ast.walk(tree):
        if isinstance(n, ast.If | ast.For | ast.AsyncFor | ast.While | ast.ExceptHandler | ast.IfExp):
            branches += 1
        elif isinstance(n, ast.comprehension):
            branches += len(n.ifs)
        elif isinstance(n, ast.match_case):
            branches += 1 + (n.guard is not None)
        elif isinstance(n, ast.BoolOp):
            branches += len(n.values) - 1
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            functions += 1
    return branches, functions


_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?|[#@]?[\w$]+|=>|\.\.\.|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.(?!\d)|[=!]==?|[<>]=|\s+|.", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_NAME = re.compile(r"#?[\w$]+\Z")
#: after these a slash begins a pattern, and an angle bracket an element
_BEFORE_VALUE = {"", "(", ",", "=", ":", "[", "!", "&&", "||", "??", "?", "{", "}", ";", "=>", "return", "typeof", "case", "do", "else", "in", "of", "yield", "await", "default", "+", "-", "*", "%", "<", ">", "==", "===", "!=", "!==", "&", "|", "^", "~", "...", "throw", "void", "delete", "new"}
_NO_METHOD = {"function", "return", "await", "typeof", "super", "new"}


REACH = 2000


class Tokens:
    """The tokens of a source as a list: strings, templates, patterns and texts of elements are ``''``, code inside them stays."""

    def __init__(self, source: str, elements: bool) -> None:
        self.s, self.elements, self.out = source, elements, []
        at = 0
        while at < len(source):
            at = self.code(at, None)

    def code(self, at: int, end: str | None) -> int:
        """Reads from ``at`` to the closing ``end`` of this level; the place behind it."""
        s, out, deep = self.s, self.out, 0
        while at < len(s):
            c, last = s[at], out[-1] if out else ""
            if c == "`":
                at = self.template(at + 1)
                continue
            if c == "/" and last in _BEFORE_VALUE and (m := _REGEX.match(s, at)):
                out.append("''")
                at = m.end()
                continue
            if c == "<" and self.elements and last in _BEFORE_VALUE and re.match(r"<(?:>|[A-Za-z][\w.:-]*(?=[\s/>])(?!\s+extends\b))", s[at : at + 200]):
                at = self.element(at)
                continue
            m = _TOKEN.match(s, at)
            t, at = m[0], m.end()
            if t.isspace() or t.startswith(("//", "/*")):
                continue
            if t == "{":
                deep += 1
            elif t == "}":
                if end == "}" and deep == 0:
                    return at
                deep -= 1
            out.append("''" if t[0] in "'\"" else t)
        return at

    def template(self, at: int) -> int:
        s = self.s
        self.out.append("''")
        while at < len(s):
            if s[at] == "\\":
                at += 2
            elif s[at] == "`":
                return at + 1
            elif s.startswith("${", at):
                self.out += ["+", "("]
                at = self.code(at + 2, "}")
                self.out.append(")")
            else:
                at += 1
        return at

    def element(self, at: int) -> int:
        """An element with its attributes and children: only code in braces counts."""
        s, open_tags = self.s, 0
        self.out.append("''")
        while at < len(s):
            closing = s.startswith("</", at)
            at += 1
            while at < len(s) and s[at] != ">":
                if s[at] in "'\"":
                    end = s.find(s[at], at + 1)
                    at = len(s) if end < 0 else end + 1
                elif s[at] == "{":
                    self.out += ["+", "("]
                    at = self.code(at + 1, "}")
                    self.out.append(")")
                else:
                    at += 1
            open_tags += -1 if closing else 0 if s[at - 1 : at] == "/" else 1
            at += 1
            while open_tags > 0 and at < len(s) and s[at] != "<":
                if s[at] == "{":
                    self.out += ["+", "("]
                    at = self.code(at + 1, "}")
                    self.out.append(")")
                else:
                    at += 1
            if open_tags <= 0:
                break
        return at


class Script:
    """Brackets of a token list, and what each brace holds."""

    def __init__(self, tokens: list[str]) -> None:
        self.t = t = tokens
        self.match, self.inside, stack = {}, [-1] * len(t), []
        for i, x in enumerate(t):
            if x in ")]}" and stack:
                self.match[stack[-1]], self.match[i] = i, stack[-1]
                stack.pop()
            self.inside[i] = stack[-1] if stack else -1
            if x in "([{":
                stack.append(i)
        self.kinds: dict[int, str] = {}

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def back(self, i: int, stops: str) -> list[int]:
        """Places before ``i`` on its level, latest first, to a stop or the level's beginning; a head has under ``REACH`` tokens."""
        out, level, stops = [], self.inside[i], stops.split()
        i -= 1
        while i > level and self.at(i) not in stops and len(out) < REACH:
            out.append(i)
            i = self.match.get(i, i) if self.at(i) in ")]}" else i
            i -= 1
        return out

    def kind(self, brace: int) -> str:
        """class, type, object or block."""
        if brace < 0 or self.at(brace) != "{":
            return "block"
        if brace not in self.kinds:
            words = [self.at(i) for i in self.back(brace, "; { } = ( , =>")]
            prev = self.at(brace - 1)
            declared = [self.at(i) for i in self.back(brace, "; { }")]
            if "class" in words:
                got = "class"
            elif "interface" in words or (prev == "=" and len(declared) > 2 and "type" in declared[-2:]):
                got = "type"
            elif prev in _BEFORE_VALUE - {";", "{", "}", "=>", "do", "else", ""} and prev != ")":
                got = "object"
            else:
                got = "block"
            self.kinds[brace] = got
        return self.kinds[brace]

    def has_body(self, close: int) -> bool:
        """A parameter list's end is followed by a body, perhaps behind a type."""
        i = close + 1
        if self.at(i) == ":":
            i += 1
            while i < len(self.t):
                x = self.at(i)
                if x == "{" and self.at(i - 1) not in (":", "|", "&", "=>", "<", ","):
                    return True
                if x in ";})" or x == "=":
                    return False
                i = self.match.get(i, i) + 1 if x in "([{" else i + 1
            return False
        return self.at(i) == "{"

    def in_type(self, arrow: int) -> bool:
        """An arrow of a function's type, not of a function."""
        first = self.match.get(arrow - 1, arrow - 1) if self.at(arrow - 1) == ")" else arrow - 1
        before = first - 1
        words = [self.at(i) for i in self.back(first, "; { }")] if before >= 0 else []
        if "type" in words[-1:] and _NAME.match(words[-2] if len(words) > 1 else "") or self.kind(self.inside[arrow]) == "type":
            return True
        if self.at(before) in ("as", "satisfies", "|", "&"):
            return self.at(before) != "&" or self.at(before - 1) != "&"
        if self.at(before) == "=>":
            return self.in_type(before)
        if self.at(before) != ":":
            return False
        near = self.back(before, "; { } ,")
        if any(self.at(i) == "?" and not self.optional(i) for i in near):
            return False
        brace = self.inside[before]
        if brace >= 0 and self.at(brace) == "(":
            return True
        return self.kind(brace) == "class" or any(self.at(i) in ("const", "let", "var") for i in near)

    def optional(self, i: int) -> bool:
        """A question mark of an optional name or of a conditional type."""
        if self.at(i + 1) in (":", ",", ")", ";", "=", "]", "}", ""):
            return True
        if self.at(i + 1) == "(" and self.kind(self.inside[i]) in ("class", "type"):
            return True
        return any(self.at(k) == "extends" for k in self.back(i, "; { } , = ( :"))


def script_counts(source: str, ext: str = ".ts") -> tuple[int, int]:
    """(branches, functions) of JavaScript or TypeScript.

    if, loops, case, catch clauses, ternaries, ``&&``, ``||`` and ``??`` are branches; names
    of members, optional names and conditional types are not.  Functions with a body, arrows
    and methods are functions; signatures and types of functions are not.
    """
    code = Script(Tokens(source, ext in (".jsx", ".tsx", ".js", ".mjs", ".cjs")).out)
    t, branches, functions = code.t, 0, 0
    for i, x in enumerate(t):
        member, nxt = code.at(i - 1) in (".", "?."), code.at(i + 1)
        if x in ("&&", "||", "??"):
            branches += 1
        elif x == "?":
            branches += not code.optional(i)
        elif x in ("if", "while", "for", "case", "catch") and not member and nxt not in (":", ",", "=", "}", ")") and code.kind(code.inside[i]) not in ("class", "object"):
            branches += x == "case" or nxt in ("(", "await") or (x == "catch" and nxt == "{")
        elif x == "function" and not member and nxt not in (":", ",", "=", "}"):
            k = i + 1
            while code.at(k) != "(" and k < i + 400 and k < len(t):
                k += 1
            functions += code.has_body(code.match.get(k, k))
        elif x == "=>":
            functions += not code.in_type(i)
        elif x == "(" and i and (_NAME.match(t[i - 1]) or t[i - 1] in ("''", "]")) and t[i - 1] not in _NO_METHOD:
            brace = code.inside[i]
            start = code.match.get(i - 1, i - 1) if t[i - 1] == "]" else i - 1
            lead = code.at(start - 1)
            head = lead in ("{", "}", ";", ",", "get", "set", "async", "static", "*", "public", "private", "protected", "override", "readonly", "abstract") or lead.startswith("@") or (code.kind(brace) == "class" and lead not in (".", "=", "new", "return", "?.", ":"))
            if code.kind(brace) in ("class", "object") and head:
                functions += code.has_body(code.match.get(i, i))
    return branches, functions
