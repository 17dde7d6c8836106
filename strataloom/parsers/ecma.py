"""A recursive-descent parser of the ECMAScript grammar with JSX and TypeScript as options.

It decides whether a text follows the grammar and, on the way, records the definitions and imports that the unit
parser needs. Early errors about names (repeated or undeclared ones) are no part of the grammar here. A text is read
as a module first; what only scripts may contain (``await`` as a name, HTML-like comments) is accepted where it does
no harm.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass


class SyntaxFault(Exception):
    """The text does not follow the grammar at ``position``."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at {position}")
        self.position = position


class TooDeep(SyntaxFault):
    """The text is nested deeper than the parser goes; whether it follows the grammar is not known."""


@dataclass
class Definition:
    """A definition in source order. ``kind`` is class, function, method, variable or import.

    With events asked for there are also: scope (a function or class from its parameters to its end), bind (a name
    that a scope binds), assign (names that an assignment may change), local (a name that an import binds, ``module``
    as "module\\nsymbol"), export (a name that a declaration exports, "default" aside in ``module``) and call (a call
    of a name, or of a member of it, which is in ``module``).
    """

    kind: str
    name: str | None
    start: int
    end: int
    depth: int = 0
    module: str | None = None


NAME, PRIVATE, NUMBER, STRING, TEMPLATE, PUNCTUATOR, REGEX, END, JSX_TEXT = range(9)

# Fixed values of the language: its reserved words and punctuators.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for "
    "function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_PUNCTUATORS = (
    ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** "
    "{ } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #"
).split()

_SPACE = re.compile(r"(?:[\s\ufeff\u180e]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/|(?:\A|(?<=\n))[ \t]*-->[^\n\r]*|<!--[^\n\r]*)*")
_TOKEN = re.compile(
    r"(?P<name>(?:[A-Za-z_$\u0080-\U0010ffff]|\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\}))(?:[\w$\u200c\u200d\u0080-\U0010ffff]|\\u(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\}))*)"
    r"|(?P<private>\#(?:[A-Za-z_$\u0080-\U0010ffff])[\w$]*)"
    r"|(?P<number>0[xX][0-9A-Fa-f](?:_?[0-9A-Fa-f])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?"
    r"|(?:(?:0|[1-9](?:_?\d)*|0\d+)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)"
    r"|(?P<string>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(?P<punctuator>" + "|".join(re.escape(p) for p in sorted(_PUNCTUATORS, key=len, reverse=True)) + r")"
    r"|(?P<template>`)"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/([A-Za-z]*)")
_BAD_ESCAPE = re.compile(r"\\(?:x(?![0-9A-Fa-f]{2})|u(?!(?:[0-9A-Fa-f]{4}|\{[0-9A-Fa-f]+\})))")
_JSX_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\-\u0080-\U0010ffff]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")

_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8,
    ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor".split())

# What an expression turned out to be, as far as assignment and arrow parameters care.
OTHER, TARGET, PATTERN, COVER = range(4)


class Parser:
    """One parse of one text."""

    def __init__(self, text: str, jsx: bool = False, types: bool = False, collect: bool = True, events: bool = False):
        self.text, self.jsx, self.types, self.collect, self.events = text, jsx, types, collect, events
        self.found: list[Definition] = []
        self.failed: set[tuple] = set()
        self.depth = 0
        self.pos = 0
        self.last_end = 0
        self.in_function = self.in_async = self.in_generator = False
        self.in_loop = self.in_switch = False
        self.labels: list[str] = []
        self.ambient = False
        self.no_in = False
        self.no_conditional = False
        if text.startswith("#!"):
            self.pos = len(re.match(r"[^\n\r]*", text).group())
        self.advance()

    # ---- tokens

    def advance(self) -> None:
        """Read the next token."""
        self.last_end = self.pos
        m = _SPACE.match(self.text, self.pos)
        start = m.end()
        self.newline = any(ch in self.text[self.pos : start] for ch in "\n\r\u2028\u2029")
        self.start = start
        if start >= len(self.text):
            self.kind, self.value, self.pos = END, "", start
            return
        if self.text.startswith("/*", start):
            raise SyntaxFault("a comment does not end", start)
        m = _TOKEN.match(self.text, start)
        if m is None:
            raise SyntaxFault("no token", start)
        group = m.lastgroup
        self.pos = m.end()
        self.value = m.group()
        self.escaped = False
        if group == "name":
            self.kind = NAME
            if "\\" in self.value:
                self.escaped = True
            for ch in self.value:
                if ord(ch) > 127 and not (ch.isalnum() or ch in "\u200c\u200d" or ch.isidentifier()):
                    raise SyntaxFault("no letter", start)
        elif group == "punctuator":
            self.kind = PUNCTUATOR
            if self.value == "?." and self.text[self.pos : self.pos + 1].isdigit():
                self.value, self.pos = "?", start + 1
        elif group == "string":
            self.kind = STRING
            if "\\" in self.value and _BAD_ESCAPE.search(self.value.replace("\\\\", "")):
                raise SyntaxFault("bad escape", start)
        elif group == "number":
            self.kind = NUMBER
            if self.pos < len(self.text) and re.match(r"[\w$\\]", self.text[self.pos]):
                raise SyntaxFault("a name follows a number", start)
        elif group == "template":
            self.kind = TEMPLATE
        else:
            self.kind = PRIVATE

    def state(self) -> tuple:
        """Everything that :meth:`reset` needs."""
        return (self.pos, self.start, self.kind, self.value, self.newline, self.last_end, self.escaped, self.depth,
                len(self.found), self.in_function, self.in_async, self.in_generator, self.no_in, self.no_conditional,
                self.ambient, self.in_loop, self.in_switch, len(self.labels))

    def reset(self, s: tuple) -> None:
        """Go back to an earlier state."""
        (self.pos, self.start, self.kind, self.value, self.newline, self.last_end, self.escaped, self.depth, n,
         self.in_function, self.in_async, self.in_generator, self.no_in, self.no_conditional, self.ambient,
         self.in_loop, self.in_switch, k) = s
        del self.found[n:]
        del self.labels[k:]

    escaped = False
    furthest: SyntaxFault | None = None

    def attempt(self, rule, *args):
        """The result of a rule, or None with everything as it was. What failed once at a place is not tried again
        there: an outer attempt that fails would otherwise double the work of every inner one."""
        key = (rule.__name__, self.start, args, self.no_conditional, self.in_async, self.in_generator)
        if key in self.failed:
            return None
        s = self.state()
        try:
            return rule(*args)
        except SyntaxFault as fault:
            if self.furthest is None or fault.position > self.furthest.position:
                self.furthest = fault
            self.reset(s)
            self.failed.add(key)
            return None

    def fault(self, message: str = "unexpected token"):
        raise SyntaxFault(message, self.start)

    def at(self, value: str) -> bool:
        """Whether the token is this punctuator or word."""
        return self.value == value and (self.kind == PUNCTUATOR or self.kind == NAME and not self.escaped)

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.advance()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.eat(value):
            self.fault(f"expected {value}")

    def split(self, first: str) -> bool:
        """Take one character of a longer punctuator: the > of >>."""
        if self.kind == PUNCTUATOR and self.value.startswith(first):
            if self.value == first:
                self.advance()
            else:
                self.pos = self.start + 1
                self.advance()
            return True
        return False

    def semicolon(self) -> None:
        """A semicolon, written or inserted."""
        if self.eat(";") or self.at("}") or self.kind == END or self.newline:
            return
        self.fault("expected ;")

    def is_name(self) -> bool:
        """Whether the token can be a binding or reference."""
        if self.kind != NAME or self.value in RESERVED:
            return False
        if self.value == "yield" and self.in_generator:
            return False
        return not (self.value == "await" and self.in_async)

    def name(self) -> str:
        if not self.is_name():
            self.fault("expected a name")
        value = self.value
        self.advance()
        return value

    def any_name(self) -> str:
        if self.kind != NAME:
            self.fault("expected a name")
        value = self.value
        self.advance()
        return value

    # ---- program and statements

    def program(self) -> list[Definition]:
        """The whole text."""
        while self.kind != END:
            self.statement(top=True, listed=True)
        return self.found

    def block(self) -> None:
        self.expect("{")
        while not self.at("}"):
            if self.kind == END:
                self.fault("a block does not end")
            self.statement(listed=True)
        self.advance()

    def define(self, kind: str, name: str | None, start: int, **more) -> None:
        if self.collect and not self.ambient:
            self.found.append(Definition(kind, name, start, self.last_end, self.depth, **more))

    def event(self, kind: str, name: str | None, start: int, module: str | None = None) -> None:
        """Note something other than a definition, if it is asked for; undone with everything else on a reset."""
        if self.events and not self.ambient:
            self.found.append(Definition(kind, name, start, self.last_end, self.depth, module))

    def changed(self, start: int, end: int) -> None:
        """Note the names that a target between two positions may change; too many rather than too few."""
        if self.events:
            for m in _FREE_NAME.finditer(self.text, start, end):
                self.event("assign", m.group(), m.start())

    def peek(self) -> tuple[int, str, bool]:
        """Kind and value of the next token, and whether a line end comes before it."""
        s = self.state()
        try:
            self.advance()
            return self.kind, self.value, self.newline
        except SyntaxFault:
            return END, "", False
        finally:
            self.reset(s)

    def statement(self, top: bool = False, listed: bool = False) -> None:
        kind, value = self.kind, self.value
        if kind == PUNCTUATOR:
            if value == "{":
                self.block()
                return
            if value == ";":
                self.advance()
                return
            if value == "@":
                self.decorators()
                if self.at("export"):
                    self.export_statement()
                    return
                if self.types and self.at("abstract"):
                    self.advance()
                self.class_(statement=True, start=self.start)
                return
        if kind == NAME and not self.escaped:
            method = _STATEMENTS.get(value)
            if method is not None:
                if value == "import" and self.peek()[1] in ("(", "."):
                    pass
                elif value == "let" and not self.let_declaration():
                    pass
                elif value == "async" and not self.async_function():
                    pass
                elif value in ("const", "let", "class", "import", "export") and not listed and value != "let":
                    self.fault("a declaration needs a block")
                elif value in ("import", "export") and not (top or self.types):
                    self.fault("only at the top")
                else:
                    method(self)
                    return
            elif self.types and value in _TYPE_STATEMENTS and self.type_statement(value):
                return
            elif value == "using" and self.is_plain_name_next():
                self.advance()
                self.declarators("const")
                self.semicolon()
                return
            if self.is_name() and self.peek()[1] == ":" :
                label = self.name()
                self.advance()
                self.labels.append(label)
                self.statement()
                self.labels.pop()
                return
        self.expression()
        self.semicolon()

    def is_plain_name_next(self) -> bool:
        kind, value, newline = self.peek()
        return kind == NAME and not newline and value not in RESERVED and value not in ("in", "of")

    def let_declaration(self) -> bool:
        kind, value, _ = self.peek()
        return kind == NAME and value not in ("in", "instanceof", "of") and value not in RESERVED or value in ("[", "{")

    def async_function(self) -> bool:
        _, value, newline = self.peek()
        return value == "function" and not newline

    def variable_statement(self) -> None:
        start, kind = self.start, self.value
        self.advance()
        if self.types and kind == "const" and self.at("enum"):
            self.enum(start)
            return
        at = len(self.found)
        names = self.declarators(kind)
        self.semicolon()
        self.variable_spans(at, names, start)

    def variable_spans(self, at: int, declared: int, start: int) -> None:
        """A lone declarator has the span of its declaration."""
        if declared == 1:
            for d in self.found[at:]:
                if d.kind == "variable" and d.depth == self.depth:
                    d.start, d.end = start, self.last_end

    def declarators(self, kind: str, loop: bool = False) -> int:
        count = 0
        while True:
            count += 1
            start = self.start
            plain = self.is_name()
            name = self.value if plain else None
            self.binding()
            if self.types and plain and self.at("!"):
                self.advance()
            if self.types and self.at(":"):
                self.advance()
                self.type()
            if self.at("="):
                self.advance()
                self.depth += 1
                shape = self.assignment()
                self.depth -= 1
                if shape == "function" and name:
                    self.define("variable", name, start, module=kind)
            elif not loop and not self.ambient and (not plain or kind == "const"):
                self.fault("expected a value")
            elif loop and not (self.at("of") or self.at("in")) and not plain:
                self.fault("expected a value")
            if not self.eat(","):
                return count

    def if_statement(self) -> None:
        self.advance()
        self.expect("(")
        self.expression()
        self.expect(")")
        self.body()
        if self.eat("else"):
            self.body()

    def body(self) -> None:
        if self.at("function") and self.peek()[1] != "*":
            self.function_statement()
        elif self.kind == NAME and self.value in ("class", "const") or self.at("let") and self.peek()[1] == "[":
            self.fault("a declaration needs a block")
        else:
            self.statement()

    def loop_body(self) -> None:
        loop, self.in_loop = self.in_loop, True
        self.body()
        self.in_loop = loop

    def for_statement(self) -> None:
        self.advance()
        waits = self.eat("await")
        self.expect("(")
        self.no_in = True
        declared = None
        if self.at(";"):
            pass
        elif self.kind == NAME and (self.value in ("var", "const") or self.value == "let" and self.let_declaration()):
            declared = self.value
            self.advance()
            count = self.declarators(declared, loop=True)
            if self.at("of") or self.at("in"):
                if count != 1:
                    self.fault("one binding only")
        else:
            begin = self.start
            shape = self.expression()
            if self.at("of") or self.at("in"):
                if shape not in (TARGET, PATTERN):
                    self.fault("no target")
                self.changed(begin, self.last_end)
        self.no_in = False
        if self.at("of"):
            self.advance()
            self.assignment()
        elif self.at("in") and not waits:
            self.advance()
            self.expression()
        else:
            if waits:
                self.fault("expected of")
            self.expect(";")
            if not self.at(";"):
                self.expression()
            self.expect(";")
            if not self.at(")"):
                self.expression()
        self.expect(")")
        self.loop_body()

    def while_statement(self) -> None:
        self.advance()
        self.expect("(")
        self.expression()
        self.expect(")")
        self.loop_body()

    def do_statement(self) -> None:
        self.advance()
        self.loop_body()
        self.expect("while")
        self.expect("(")
        self.expression()
        self.expect(")")
        self.eat(";")

    def jump_statement(self) -> None:
        word = self.value
        at = self.start
        self.advance()
        if self.kind == NAME and not self.newline and self.is_name():
            if self.value not in self.labels:
                self.fault("no such label")
            self.advance()
        elif not (self.in_loop or word == "break" and self.in_switch):
            raise SyntaxFault("nothing to leave", at)
        self.semicolon()

    def return_statement(self) -> None:
        if not self.in_function:
            self.fault("return outside a function")
        self.advance()
        if not (self.at(";") or self.at("}") or self.kind == END or self.newline):
            self.expression()
        self.semicolon()

    def throw_statement(self) -> None:
        self.advance()
        if self.newline:
            self.fault("expected a value")
        self.expression()
        self.semicolon()

    def try_statement(self) -> None:
        self.advance()
        self.block()
        handled = False
        if self.eat("catch"):
            handled = True
            if self.eat("("):
                self.binding()
                if self.types and self.eat(":"):
                    self.type()
                self.expect(")")
            self.block()
        if self.eat("finally"):
            handled = True
            self.block()
        if not handled:
            self.fault("expected catch or finally")

    def switch_statement(self) -> None:
        self.advance()
        self.expect("(")
        self.expression()
        self.expect(")")
        self.expect("{")
        switch, self.in_switch = self.in_switch, True
        default = False
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            elif self.at("default") and not default:
                default = True
                self.advance()
            else:
                self.fault("expected case")
            self.expect(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                if self.kind == END:
                    self.fault("a switch does not end")
                self.statement(listed=True)
        self.in_switch = switch

    def with_statement(self) -> None:
        self.fault("with is no part of a module")

    def debugger_statement(self) -> None:
        self.advance()
        self.semicolon()

    # ---- functions and classes

    def function_statement(self, exported: int | None = None, optional_name: bool = False) -> None:
        start = self.start
        is_async = self.eat("async")
        self.expect("function")
        generator = self.eat("*")
        name = None
        if not (optional_name and (self.at("(") or self.types and self.at("<"))):
            self.event("bind", self.value, self.start)
            name = self.name()
        bodied = self.function_rest(is_async, generator, overload=self.types)
        if bodied:
            self.define("function", name, start if exported is None else exported)

    def function_rest(self, is_async: bool, generator: bool, overload: bool = False, arrow: bool = False) -> bool:
        """Type parameters, parameters, result type and body; False for a mere signature."""
        outer = (self.in_function, self.in_async, self.in_generator, self.no_in, self.in_loop, self.in_switch, self.labels, self.no_conditional)
        self.in_function, self.in_async, self.in_generator, self.no_in = True, is_async, generator, False
        self.in_loop, self.in_switch, self.labels, self.no_conditional = False, False, [], False
        begin = self.start
        try:
            if self.types and self.at("<"):
                self.type_parameters()
            self.parameters()
            if self.types and self.eat(":"):
                self.return_type()
            if overload and not self.at("{"):
                self.semicolon()
                return False
            self.function_body()
            self.event("scope", None, begin, "function")
            return True
        finally:
            (self.in_function, self.in_async, self.in_generator, self.no_in, self.in_loop, self.in_switch, self.labels, self.no_conditional) = outer

    def function_body(self) -> None:
        self.depth += 1
        self.block()
        self.depth -= 1

    def parameters(self) -> None:
        self.expect("(")
        while not self.at(")"):
            while self.at("@"):
                self.decorators()
            if self.eat("..."):
                self.binding()
                if self.types and self.eat(":"):
                    self.type()
                break
            if self.types:
                while self.kind == NAME and self.value in _MODIFIERS and self.peek()[0] == NAME or self.kind == NAME and self.value in ("public", "private", "protected", "readonly") and self.peek()[1] in ("{", "["):
                    self.advance()
                if self.at("this"):
                    self.advance()
                    self.expect(":")
                    self.type()
                    if not self.eat(","):
                        break
                    continue
            self.binding()
            if self.types:
                self.eat("?")
                if self.eat(":"):
                    self.type()
            if self.eat("="):
                self.assignment()
            if not self.eat(","):
                break
        self.expect(")")

    def binding(self) -> None:
        """A name or a destructuring pattern."""
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding()
                if not rest and self.eat("="):
                    self.inner_assignment()
                if not self.at("]"):
                    if rest:
                        self.fault("a rest comes last")
                    self.expect(",")
            return
        if self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.event("bind", self.value, self.start)
                    self.name()
                    if not self.at("}"):
                        self.fault("a rest comes last")
                    continue
                short = self.is_name()
                key, begin = self.value, self.start
                self.property_name()
                if self.eat(":"):
                    self.binding()
                elif not short:
                    self.fault("expected :")
                else:
                    self.event("bind", key, begin)
                if self.eat("="):
                    self.inner_assignment()
                if not self.at("}"):
                    self.expect(",")
            return
        self.event("bind", self.value, self.start)
        self.name()

    def inner_assignment(self):
        outer, self.no_in = self.no_in, False
        shape = self.assignment()
        self.no_in = outer
        return shape

    def property_name(self) -> str | None:
        if self.kind in (NAME, STRING, NUMBER, PRIVATE):
            value = self.value
            self.advance()
            return value
        self.expect("[")
        self.inner_assignment()
        self.expect("]")
        return None

    def decorators(self) -> None:
        while self.eat("@"):
            if self.eat("("):
                self.expression()
                self.expect(")")
            else:
                self.any_name()
                while self.eat("."):
                    if self.kind == PRIVATE:
                        self.advance()
                    else:
                        self.any_name()
                if self.types and self.at("<"):
                    self.attempt(self.type_arguments)
                if self.at("("):
                    self.arguments()

    def class_statement(self) -> None:
        self.class_(statement=True, start=self.start)

    def class_(self, statement: bool, start: int, optional_name: bool = False) -> None:
        self.expect("class")
        name = None
        if self.is_name() and not (self.at("implements") and self.types and self.peek()[1] not in ("{", "extends", "<", "implements")):
            self.event("bind", self.value, self.start)
            name = self.name()
        elif statement and not optional_name:
            self.fault("expected a name")
        if self.types and self.at("<"):
            self.type_parameters()
        if self.eat("extends"):
            self.left_hand_side()
            if self.types and self.at("<"):
                self.type_arguments()
        if self.types and self.eat("implements"):
            while True:
                self.type()
                if not self.eat(","):
                    break
        at = len(self.found)
        begin = self.start
        self.expect("{")
        self.depth += 1
        while not self.eat("}"):
            if self.kind == END:
                self.fault("a class does not end")
            if not self.eat(";"):
                self.member()
        self.depth -= 1
        self.event("scope", None, begin, "class")
        if statement and self.collect and not self.ambient:
            self.found.insert(at, Definition("class", name, start, self.last_end, self.depth))

    def member(self) -> None:
        while self.at("@"):
            self.decorators()
        start = self.start
        is_async = generator = accessor = static = False
        stop = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        abstract = False
        while self.kind == NAME and not self.escaped and (self.value in ("static", "async", "get", "set", "accessor") or self.types and self.value in _MODIFIERS):
            word = self.value
            kind, value, newline = self.peek()
            if value in stop and kind == PUNCTUATOR and not (value == "<" and not self.types) or kind == END:
                break
            if newline and word in ("async", "accessor", "get", "set") and word != "get" and word != "set":
                break
            if newline and word in _MODIFIERS and word not in ("static", "async"):
                break
            if word == "static" and value == "{":
                self.advance()
                outer = (self.in_function, self.in_async, self.in_generator, self.in_loop, self.in_switch)
                self.in_function, self.in_async, self.in_generator, self.in_loop, self.in_switch = False, True, False, False, False
                self.block()
                self.in_function, self.in_async, self.in_generator, self.in_loop, self.in_switch = outer
                return
            self.advance()
            if word == "async":
                is_async = True
                break
            if word in ("get", "set"):
                accessor = True
                break
            static = static or word == "static"
            abstract = abstract or word in ("abstract", "declare")
        if self.eat("*"):
            generator = True
        if self.types and self.at("[") and not (is_async or generator or accessor) and self.attempt(self.index_signature):
            self.member_end()
            return
        plain = self.kind in (NAME, PRIVATE)
        name = self.property_name()
        if self.types and (self.at("?") or self.at("!")):
            self.advance()
        if self.at("(") or self.types and self.at("<"):
            if self.function_rest(is_async, generator, overload=self.types) and plain:
                self.define("method", name, start)
            return
        if is_async or generator or accessor:
            self.fault("expected parameters")
        if self.types and self.eat(":"):
            self.type()
        if self.eat("="):
            outer = (self.in_function, self.in_async, self.in_generator)
            self.in_function, self.in_async, self.in_generator = True, False, False
            self.assignment()
            self.in_function, self.in_async, self.in_generator = outer
        self.member_end()

    def member_end(self) -> None:
        if not (self.eat(";") or self.at("}") or self.newline):
            self.fault("expected ;")

    # ---- modules

    def import_statement(self) -> None:
        start = self.start
        self.advance()
        if self.kind == STRING:
            module = self.value[1:-1]
            self.advance()
        else:
            if self.types and self.at("type"):
                kind, value, _ = self.peek()
                if value in ("{", "*") or kind == NAME and value != "from" or kind == NAME and value == "from" and self.type_named_from():
                    self.advance()
            more = True
            if self.is_name():
                self.event("local", self.value, self.start, "default")
                self.name()
                if self.types and self.eat("="):
                    if self.at("require"):
                        self.advance()
                        self.arguments()
                    else:
                        self.any_name()
                        while self.eat("."):
                            self.any_name()
                    self.semicolon()
                    self.define("import", None, start)
                    return
                more = self.eat(",")
            if more:
                if self.eat("*"):
                    self.expect("as")
                    self.event("local", self.value, self.start, "")
                    self.name()
                else:
                    self.module_names(binding=True)
            self.expect("from")
            module = self.module_string()
        self.import_attributes()
        self.semicolon()
        self.define("import", None, start, module=module)

    def type_named_from(self) -> bool:
        s = self.state()
        self.advance()
        self.advance()
        named = self.at("from")
        self.reset(s)
        return named

    def module_names(self, binding: bool) -> None:
        self.expect("{")
        while not self.eat("}"):
            mere_type = self.types and self.at("type") and self.peek()[1] not in (",", "}", "as")
            if mere_type:
                self.advance()
            plain = self.is_name()
            original, begin = self.value, self.start
            if self.kind == STRING:
                self.advance()
            else:
                self.any_name()
            if binding:
                alias = self.at("as")
                local = self.peek()[1] if alias else original
                self.event("bind" if mere_type else "local", local, begin, original)
            if self.eat("as"):
                if binding:
                    self.name()
                elif self.kind == STRING:
                    self.advance()
                else:
                    self.any_name()
            elif binding and not plain:
                self.fault("expected a name")
            if not self.at("}"):
                self.expect(",")

    def module_string(self) -> str:
        if self.kind != STRING:
            self.fault("expected a module")
        value = self.value[1:-1]
        self.advance()
        return value

    def import_attributes(self) -> None:
        if (self.at("with") or self.at("assert") and not self.newline) and self.peek()[1] == "{":
            self.advance()
            self.expect("{")
            while not self.eat("}"):
                self.property_name()
                self.expect(":")
                self.module_string()
                if not self.at("}"):
                    self.expect(",")

    def export_statement(self) -> None:
        start = self.start
        self.advance()
        if self.eat("*"):
            if self.eat("as"):
                if self.kind == STRING:
                    self.advance()
                else:
                    self.any_name()
            self.expect("from")
            self.module_string()
            self.import_attributes()
            self.semicolon()
        elif self.at("{") or self.types and self.at("type") and self.peek()[1] in ("{", "*"):
            self.eat("type")
            if self.eat("*"):
                if self.eat("as"):
                    self.any_name()
                self.expect("from")
                self.module_string()
            else:
                self.module_names(binding=False)
                if self.eat("from"):
                    self.module_string()
                    self.import_attributes()
            self.semicolon()
        elif self.eat("default"):
            if self.at("function") or self.at("async") and self.async_function():
                self.function_statement(exported=start, optional_name=True)
            elif self.at("class") or self.at("@") or self.types and self.at("abstract") and self.peek()[1] == "class":
                self.decorators()
                self.eat("abstract")
                self.class_(statement=True, start=start, optional_name=True)
            elif self.types and self.at("interface") and self.is_plain_name_next():
                self.type_statement("interface")
            else:
                self.assignment()
                self.semicolon()
        elif self.types and self.eat("="):
            self.expression()
            self.semicolon()
        elif self.types and self.at("as") and self.peek()[1] == "namespace":
            self.advance()
            self.advance()
            self.name()
            self.semicolon()
        elif self.types and self.at("import"):
            self.import_statement()
        elif self.at("function") or self.at("async") and self.async_function():
            self.function_statement(exported=start)
        elif self.at("class") or self.at("@"):
            self.decorators()
            self.class_(statement=True, start=start)
        elif self.at("var") or self.at("const") or self.at("let") and self.let_declaration():
            at = len(self.found)
            kind = self.value
            self.advance()
            if self.types and kind == "const" and self.at("enum"):
                self.enum(start)
                return
            count = self.declarators(kind)
            self.semicolon()
            self.variable_spans(at, count, start)
        elif self.types and self.kind == NAME and self.value in _TYPE_STATEMENTS:
            at = len(self.found)
            if not self.type_statement(self.value):
                self.fault()
            for d in self.found[at : at + 1]:
                if d.kind == "class":
                    d.start = start
        else:
            self.fault("nothing to export")

    # ---- expressions

    def expression(self):
        shape = self.assignment()
        while self.at(","):
            self.advance()
            self.assignment()
            shape = OTHER
        return shape

    def assignment(self, cover: bool = False):
        """An assignment expression; gives what it is as a target, or "function" for a function value, or "default"
        for a target with a value. An object with default values (COVER) is a fault unless ``cover`` allows it."""
        if self.kind == NAME and not self.escaped:
            if self.value == "yield" and self.in_generator:
                return self.yield_()
            if self.value == "async" and not self.peek()[2]:
                found = self.attempt(self.async_arrow)
                if found is not None:
                    return found
            elif self.is_name() and self.peek()[1] == "=>":
                begin = self.start
                self.event("bind", self.value, begin)
                self.name()
                if self.newline:
                    self.fault()
                return self.arrow_rest(False, begin)
        if self.kind == PUNCTUATOR:
            if self.value == "(":
                found = self.attempt(self.arrow, False)
                if found is not None:
                    return found
            elif self.value == "<" and self.types and not self.jsx:
                found = self.attempt(self.arrow, False)
                if found is not None:
                    return found
            elif self.value == "<" and self.types:
                found = self.attempt(self.arrow, False)
                if found is not None:
                    return found
        if self.kind == NAME and self.value == "function" or self.at("async") and self.async_function():
            direct = True
        else:
            direct = False
        start = self.start
        shape = self.conditional()
        if self.kind == PUNCTUATOR and self.value in _ASSIGN:
            if shape == TARGET or self.value == "=" and shape == PATTERN:
                plain = self.value == "="
                self.changed(start, self.start)
                self.advance()
                self.assignment()
                return "default" if plain else OTHER
            self.fault("no target")
        if shape == COVER and not cover:
            raise SyntaxFault("a default value outside a pattern", start)
        if direct and shape == "function":
            return "function"
        return OTHER if shape == "function" else shape

    def yield_(self):
        self.advance()
        if self.newline:
            return OTHER
        if self.eat("*"):
            self.assignment()
        elif not (self.kind == END or self.kind == PUNCTUATOR and self.value in (")", "]", "}", ",", ";", ":") or self.at("in") or self.at("of")):
            self.assignment()
        return OTHER

    def async_arrow(self):
        self.expect("async")
        if self.is_name() and self.peek()[1] == "=>":
            begin = self.start
            self.event("bind", self.value, begin)
            self.name()
            return self.arrow_rest(True, begin)
        if self.at("(") or self.types and self.at("<"):
            return self.arrow(True)
        self.fault()

    def arrow(self, is_async: bool):
        conditional = self.no_conditional
        self.no_conditional = False
        begin = self.start
        if self.types and self.at("<"):
            self.type_parameters()
        outer = self.in_async
        self.in_async = is_async or outer
        self.parameters()
        self.in_async = outer
        if self.types and self.at(":"):
            self.advance()
            self.return_type()
        if not self.at("=>") or self.newline:
            self.fault("expected =>")
        if conditional and self.types:
            s = self.state()
            shape = self.arrow_rest(is_async, begin)
            self.no_conditional = conditional
            if not self.at(":"):
                self.reset(s)
                self.fault("part of a conditional")
            return shape
        self.no_conditional = conditional
        return self.arrow_rest(is_async, begin)

    def arrow_rest(self, is_async: bool, begin: int):
        self.expect("=>")
        outer = (self.in_function, self.in_async, self.in_generator, self.in_loop, self.in_switch, self.labels)
        self.in_function, self.in_async, self.in_generator = True, is_async, False
        self.in_loop, self.in_switch, self.labels = False, False, []
        try:
            if self.at("{"):
                no_in, self.no_in = self.no_in, False
                self.function_body()
                self.no_in = no_in
            else:
                self.assignment()
            self.event("scope", None, begin, "arrow")
        finally:
            self.in_function, self.in_async, self.in_generator, self.in_loop, self.in_switch, self.labels = outer
        return "function"

    def conditional(self):
        shape = self.binary(0)
        if self.at("?"):
            self.advance()
            no_in, self.no_in = self.no_in, False
            conditional, self.no_conditional = self.no_conditional, self.types
            self.assignment()
            self.no_in, self.no_conditional = no_in, conditional
            self.expect(":")
            self.assignment()
            return OTHER
        return shape

    def binary(self, least: int):
        if self.kind == PRIVATE and self.peek()[1] == "in":
            self.advance()
            shape = OTHER
        else:
            shape = self.unary()
        mixed = 0
        while True:
            if self.types and self.kind == NAME and self.value in ("as", "satisfies") and not self.newline and least < 8:
                self.advance()
                if not self.eat("const"):
                    self.type()
                shape = TARGET if shape == TARGET else OTHER
                continue
            power = _BINARY.get(self.value) if self.kind in (PUNCTUATOR, NAME) and not self.escaped else None
            if power is None or power <= least or self.value == "in" and self.no_in:
                return shape
            if self.kind == NAME and self.value not in ("in", "instanceof"):
                return shape
            if shape == COVER:
                self.fault("a default value outside a pattern")
            operator = self.value
            if operator == "??":
                mixed |= 1
            elif operator in ("||", "&&"):
                mixed |= 2
            if mixed == 3:
                self.fault("?? needs parentheses")
            if operator == "**" and shape == "unary":
                self.fault("a power of a signed value")
            self.advance()
            # the right side of ?? ends before || and &&, so that mixing them is seen here
            if self.binary(11 if operator == "**" else 3 if operator == "??" else power) == COVER:
                self.fault("a default value outside a pattern")
            shape = OTHER

    def unary(self):
        if self.kind == PUNCTUATOR:
            if self.value in ("!", "~", "+", "-"):
                self.advance()
                self.unary()
                return "unary"
            if self.value in ("++", "--"):
                self.advance()
                begin = self.start
                if self.unary() != TARGET:
                    self.fault("no target")
                self.changed(begin, self.last_end)
                return OTHER
            if self.value == "<" and self.types and not self.jsx:
                self.advance()
                if not self.eat("const"):
                    self.type()
                self.split(">") or self.fault()
                return self.unary()
        elif self.kind == NAME and not self.escaped:
            if self.value in ("typeof", "void", "delete"):
                removes = self.value == "delete"
                self.advance()
                begin = self.start
                self.unary()
                if removes:
                    self.changed(begin, self.last_end)
                return "unary"
            if self.value == "await" and (self.in_async or not self.in_function and self.awaits()):
                self.advance()
                self.unary()
                return "unary"
        begin = self.start
        shape = self.left_hand_side()
        if self.kind == PUNCTUATOR and self.value in ("++", "--") and not self.newline:
            if shape != TARGET:
                self.fault("no target")
            self.changed(begin, self.last_end)
            self.advance()
            return OTHER
        return shape

    def awaits(self) -> bool:
        """Whether a top-level await is meant rather than a name."""
        kind, value, newline = self.peek()
        return kind in (NAME, STRING, NUMBER, TEMPLATE) and value not in ("in", "of", "instanceof") and not newline or value in ("(", "[", "{", "!", "+", "-")

    def left_hand_side(self):
        if self.at("new"):
            shape = self.new()
        elif self.at("super"):
            self.advance()
            if not (self.at("(") or self.at(".") or self.at("[")):
                self.fault()
            shape = OTHER
        elif self.at("import"):
            self.advance()
            if self.eat("."):
                self.any_name()
            else:
                self.arguments()
            shape = OTHER
        else:
            if self.events and self.is_name():
                self.called()
            shape = self.primary()
        return self.postfix(shape, calls=True)

    def called(self) -> None:
        """Note ``a(`` and ``a.b(`` where the expression that begins here is such a call."""
        m = _CALL.match(self.text, self.start)
        if m is not None:
            self.event("call", m.group(1), self.start, m.group(2))

    def postfix(self, shape, calls: bool):
        chained = False
        while True:
            if self.kind == TEMPLATE:
                if chained:
                    self.fault("no template in an optional chain")
                self.template()
                shape = OTHER
            elif self.kind != PUNCTUATOR:
                return shape
            elif self.value == ".":
                self.advance()
                if self.kind not in (NAME, PRIVATE):
                    self.fault("expected a name")
                self.advance()
                shape = OTHER if chained else TARGET
            elif self.value == "?." and calls:
                chained = True
                self.advance()
                if self.at("("):
                    self.arguments()
                elif self.at("["):
                    self.index()
                elif self.types and self.at("<"):
                    self.type_arguments()
                    self.arguments()
                elif self.kind in (NAME, PRIVATE):
                    self.advance()
                else:
                    self.fault("expected a name")
                shape = OTHER
            elif self.value == "[":
                self.index()
                shape = OTHER if chained else TARGET
            elif self.value == "(" and calls:
                if shape == COVER:
                    self.fault()
                self.arguments()
                shape = OTHER
            elif self.value == "!" and self.types and not self.newline:
                self.advance()
            elif self.value in ("<", "<<") and self.types:
                s = self.state()
                try:
                    self.type_arguments()
                    if self.at("(") and calls:
                        self.arguments()
                    elif self.kind == TEMPLATE:
                        self.template()
                    elif self.kind in (NAME, NUMBER, STRING) and not self.newline and self.value not in ("instanceof", "in", "as", "satisfies") or self.kind == PUNCTUATOR and self.value in ("(", "[", "{", "!", "~", "+", "-", "++", "--", "<"):
                        self.fault()
                    shape = OTHER
                except SyntaxFault:
                    self.reset(s)
                    return shape
            else:
                return shape

    def index(self) -> None:
        self.expect("[")
        no_in, self.no_in = self.no_in, False
        self.expression()
        self.no_in = no_in
        self.expect("]")

    def arguments(self) -> None:
        self.expect("(")
        outer = (self.no_in, self.no_conditional)
        self.no_in = self.no_conditional = False
        while not self.at(")"):
            self.eat("...")
            self.assignment()
            if not self.eat(","):
                break
        self.no_in, self.no_conditional = outer
        self.expect(")")

    def new(self):
        self.expect("new")
        if self.eat("."):
            if not self.at("target"):
                self.fault()
            self.advance()
            return OTHER
        if self.at("new"):
            self.new()
        elif self.at("import"):
            self.fault()
        elif self.at("super"):
            self.advance()
        else:
            self.primary()
        self.postfix(OTHER, calls=False)
        if self.at("?."):
            self.fault("no optional chain after new")
        if self.at("("):
            self.arguments()
        return OTHER

    def primary(self):
        kind, value = self.kind, self.value
        if kind == NAME:
            if not self.escaped:
                if value == "function" or value == "async" and self.async_function():
                    is_async = self.eat("async")
                    self.advance()
                    generator = self.eat("*")
                    if self.kind == NAME and value and not self.at("("):
                        outer = self.in_async, self.in_generator
                        self.in_async, self.in_generator = is_async, generator
                        self.name()
                        self.in_async, self.in_generator = outer
                    self.function_rest(is_async, generator)
                    return "function"
                if value == "class":
                    self.class_(statement=False, start=self.start)
                    return OTHER
                if value in ("this", "null", "true", "false"):
                    self.advance()
                    return OTHER
            self.name()
            return TARGET
        if kind in (NUMBER, STRING):
            self.advance()
            return OTHER
        if kind == TEMPLATE:
            self.template()
            return OTHER
        if kind == PUNCTUATOR:
            if value == "(":
                self.advance()
                outer = (self.no_in, self.no_conditional)
                self.no_in = self.no_conditional = False
                shape = self.expression()
                self.no_in, self.no_conditional = outer
                self.expect(")")
                return TARGET if shape == TARGET else OTHER
            if value == "[":
                return self.array()
            if value == "{":
                return self.object()
            if value in ("/", "/="):
                return self.regex()
            if value == "<" and self.jsx:
                self.jsx_element()
                self.advance()
                return OTHER
            if value == "@":
                self.decorators()
                self.class_(statement=False, start=self.start)
                return OTHER
        self.fault()

    def regex(self):
        m = _REGEX.match(self.text, self.start)
        flags = m.group(1) if m else ""
        if m is None or len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
            self.fault("no regex")
        _check_regex(m.group()[1 : len(m.group()) - len(flags) - 1], self.start)
        self.pos = m.end()
        self.advance()
        return OTHER

    def template(self) -> None:
        text, at = self.text, self.start + 1
        while True:
            m = _TEMPLATE_PART.match(text, at)
            at = m.end()
            if text.startswith("`", at):
                self.pos = at + 1
                self.advance()
                return
            if not text.startswith("${", at):
                raise SyntaxFault("a template does not end", at)
            self.pos = at + 2
            self.advance()
            outer = (self.no_in, self.no_conditional)
            self.no_in = self.no_conditional = False
            self.expression()
            self.no_in, self.no_conditional = outer
            if not self.at("}"):
                self.fault("expected }")
            at = self.start + 1

    def array(self):
        self.advance()
        outer = (self.no_in, self.no_conditional)
        self.no_in = self.no_conditional = False
        pattern, cover = True, False
        while not self.at("]"):
            if self.eat(","):
                continue
            spread = self.eat("...")
            shape = self.element()
            cover = cover or shape == COVER
            if shape not in (TARGET, PATTERN, COVER, "default"):
                pattern = False
            if not self.at("]"):
                if spread:
                    pattern = False
                self.expect(",")
        self.no_in, self.no_conditional = outer
        self.expect("]")
        return self.covered(pattern, cover)

    def covered(self, pattern: bool, cover: bool):
        """What a literal is, given whether it can be a pattern and whether it must be one."""
        if not cover:
            return PATTERN if pattern else OTHER
        if not pattern:
            self.fault("a default value outside a pattern")
        return PATTERN if self.at("=") or self.at("of") or self.at("in") else COVER

    def element(self):
        """An element of a literal that may turn out to be a pattern: a target with a default counts as one."""
        return self.assignment(cover=True)

    def object(self):
        self.advance()
        outer = (self.no_in, self.no_conditional)
        self.no_in = self.no_conditional = False
        pattern, cover = True, False
        while not self.at("}"):
            if self.eat("..."):
                shape = self.assignment()
                pattern = pattern and shape == TARGET
                if not self.at("}"):
                    self.expect(",")
                    pattern = False  # a rest comes last
                continue
            is_async = generator = accessor = False
            while self.kind == NAME and not self.escaped and self.value in ("async", "get", "set") and not (is_async or accessor):
                kind, value, newline = self.peek()
                if kind == PUNCTUATOR and value in ("(", ":", ",", "}", "=") or self.types and value == "<" or newline and self.value == "async":
                    break
                is_async = self.value == "async"
                accessor = not is_async
                self.advance()
            if self.eat("*"):
                generator = True
            short = self.is_name()
            if self.kind == PRIVATE:
                self.fault()
            self.property_name()
            if self.at("(") or self.types and self.at("<"):
                self.function_rest(is_async, generator)
                pattern = False
            elif is_async or generator or accessor:
                self.fault("expected parameters")
            elif self.eat(":"):
                shape = self.element()
                if shape == COVER:
                    cover = True
                elif shape not in (TARGET, PATTERN, "default"):
                    pattern = False
            elif not short:
                self.fault("expected :")
            elif self.at("="):
                self.advance()
                self.assignment()
                cover = True
            if not self.at("}"):
                self.expect(",")
        self.no_in, self.no_conditional = outer
        self.expect("}")
        return self.covered(pattern, cover)

    # ---- JSX

    def jsx_name(self) -> str:
        m = _JSX_NAME.match(self.text, self.pos)
        if m is None:
            raise SyntaxFault("expected a name", self.pos)
        self.pos = m.end()
        while self.text[self.pos : self.pos + 1] in (".", ":"):
            n = _JSX_NAME.match(self.text, self.pos + 1)
            if n is None:
                raise SyntaxFault("expected a name", self.pos)
            self.pos = n.end()
        return self.text[m.start() : self.pos]

    def jsx_space(self) -> None:
        self.pos = _SPACE.match(self.text, self.pos).end()

    def jsx_braces(self, spread_only: bool = False) -> None:
        """An expression in braces; the position is at the brace, and after it when done."""
        self.pos += 1
        self.advance()
        if self.at("}") and not spread_only:
            self.pos = self.start + 1
            return
        if self.eat("..."):
            self.assignment()
        elif spread_only:
            self.fault("expected ...")
        else:
            self.expression()
        if not self.at("}"):
            self.fault("expected }")
        self.pos = self.start + 1

    def jsx_element(self) -> None:
        """An element or fragment that begins at the current token; the position is after it when done."""
        text = self.text
        self.pos = self.start + 1
        self.jsx_space()
        if text.startswith(">", self.pos):
            name = ""
            self.pos += 1
        else:
            name = self.jsx_name()
            while True:
                self.jsx_space()
                if text.startswith("/", self.pos):
                    self.pos += 1
                    self.jsx_space()
                    if not text.startswith(">", self.pos):
                        raise SyntaxFault("expected >", self.pos)
                    self.pos += 1
                    return
                if text.startswith(">", self.pos):
                    self.pos += 1
                    break
                if text.startswith("{", self.pos):
                    self.jsx_braces(spread_only=True)
                    continue
                self.jsx_name()
                self.jsx_space()
                if text.startswith("=", self.pos):
                    self.pos += 1
                    self.jsx_space()
                    m = _JSX_STRING.match(text, self.pos)
                    if m:
                        self.pos = m.end()
                    elif text.startswith("{", self.pos):
                        self.jsx_braces()
                    elif text.startswith("<", self.pos):
                        self.start = self.pos
                        self.jsx_element()
                    else:
                        raise SyntaxFault("expected a value", self.pos)
        while True:
            m = _JSX_CHARS.match(text, self.pos)
            self.pos = m.end()
            if text.startswith("{", self.pos):
                self.jsx_braces()
            elif text.startswith("<", self.pos):
                after = _SPACE.match(text, self.pos + 1).end()
                if text.startswith("/", after):
                    self.pos = after + 1
                    self.jsx_space()
                    closing = "" if text.startswith(">", self.pos) else self.jsx_name()
                    self.jsx_space()
                    if closing != name or not text.startswith(">", self.pos):
                        raise SyntaxFault("a tag is closed by another", self.pos)
                    self.pos += 1
                    return
                self.start = self.pos
                self.jsx_element()
            else:
                raise SyntaxFault("an element does not end", self.pos)

    # ---- types

    def type_statement(self, word: str) -> bool:
        """A statement of the type system; False if the word is an ordinary name here."""
        kind, value, newline = self.peek()
        start = self.start
        if word == "interface":
            if kind != NAME or newline:
                return False
            self.advance()
            self.name()
            if self.at("<"):
                self.type_parameters()
            if self.eat("extends"):
                while True:
                    self.type()
                    if not self.eat(","):
                        break
            self.object_type()
            return True
        if word == "type":
            if kind != NAME or newline or value in ("in", "instanceof", "as", "satisfies") and self.type_is_name():
                return False
            self.advance()
            self.name()
            if self.at("<"):
                self.type_parameters()
            self.expect("=")
            self.type()
            self.semicolon()
            return True
        if word == "enum":
            self.enum(start)
            return True
        if word == "abstract":
            if value != "class" or newline:
                return False
            self.advance()
            self.class_(statement=True, start=start)
            return True
        if word == "declare":
            if kind != NAME or newline:
                return False
            self.advance()
            outer, self.ambient = self.ambient, True
            self.declaration()
            self.ambient = outer
            return True
        if word in ("namespace", "module"):
            if kind not in (NAME, STRING) or newline or kind == NAME and value in ("in", "instanceof", "of"):
                return False
            self.advance()
            self.namespace_rest()
            return True
        if word == "global":
            if value != "{" or not self.ambient:
                return False
            self.advance()
            self.block()
            return True
        return False

    def type_is_name(self) -> bool:
        s = self.state()
        self.advance()
        self.advance()
        declares = self.at("=") or self.at("<")
        self.reset(s)
        return not declares

    def namespace_rest(self) -> None:
        if self.kind == STRING:
            self.advance()
        else:
            self.name()
            while self.eat("."):
                self.any_name()
        if self.at("{"):
            self.expect("{")
            while not self.eat("}"):
                if self.kind == END:
                    self.fault("a namespace does not end")
                self.statement(top=True, listed=True)
        else:
            self.semicolon()

    def declaration(self) -> None:
        if self.at("const") and self.peek()[1] == "enum":
            start = self.start
            self.advance()
            self.enum(start)
        elif self.at("var") or self.at("let") or self.at("const"):
            kind = self.value
            self.advance()
            self.declarators(kind)
            self.semicolon()
        elif self.at("function") or self.at("async"):
            self.function_statement()
        elif self.at("class"):
            self.class_(statement=True, start=self.start)
        elif self.kind == NAME and self.value in _TYPE_STATEMENTS and self.type_statement(self.value):
            pass
        else:
            self.fault("nothing to declare")

    def enum(self, start: int) -> None:
        self.expect("enum")
        self.name()
        self.expect("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if not self.at("}"):
                self.expect(",")

    def type_parameters(self) -> None:
        self.expect("<")
        if self.at(">"):
            self.fault("expected a type parameter")
        while True:
            while self.kind == NAME and self.value in ("const", "in", "out") and self.peek()[0] == NAME and self.peek()[1] not in ("extends",):
                self.advance()
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
            if self.at(">"):
                break
        if not self.split(">"):
            self.fault("expected >")

    def type_arguments(self) -> None:
        if not self.split("<"):
            self.fault("expected <")
        while True:
            self.type()
            if not self.eat(","):
                break
        if not self.split(">"):
            self.fault("expected >")

    def return_type(self) -> None:
        """A type or a type predicate."""
        if self.at("asserts") and self.peek()[0] == NAME and not self.peek()[2]:
            self.advance()
            self.any_name()
            if self.eat("is"):
                self.type()
            return
        if self.kind == NAME and self.peek()[1] == "is" and not self.peek()[2]:
            self.advance()
            self.advance()
            self.type()
            return
        self.type()

    def type(self, conditional: bool = True) -> None:
        if self.at("abstract") and self.peek()[1] == "new":
            self.advance()
        if self.at("new"):
            self.advance()
            self.function_type()
            return
        if self.at("<"):
            self.function_type()
            return
        if self.at("(") and self.attempt(self.function_type_done):
            return
        self.union_type()
        if conditional and not self.newline and self.at("extends"):
            self.advance()
            self.type(conditional=False)
            self.expect("?")
            self.type()
            self.expect(":")
            self.type()

    def function_type_done(self) -> bool:
        self.function_type()
        return True

    def function_type(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        self.expect("=>")
        self.return_type()

    def union_type(self) -> None:
        self.eat("|") or self.eat("&")
        while True:
            self.postfix_type()
            if not (self.eat("|") or self.eat("&")):
                return

    def postfix_type(self) -> None:
        if self.kind == NAME and self.value in ("keyof", "unique", "readonly", "infer") and self.type_operator():
            word = self.value
            self.advance()
            if word == "infer":
                self.name()
                if self.at("extends"):
                    s = self.state()
                    try:
                        self.advance()
                        self.type(conditional=False)
                        if self.at("?"):
                            self.fault()
                    except SyntaxFault:
                        self.reset(s)
                return
            self.postfix_type()
            return
        self.primary_type()
        while not self.newline and self.at("["):
            self.advance()
            if not self.at("]"):
                self.type()
            self.expect("]")

    def type_operator(self) -> bool:
        kind, value, _ = self.peek()
        return kind in (NAME, STRING, NUMBER, TEMPLATE) and value not in ("extends", "is", "as") or value in ("(", "[", "{")

    def primary_type(self) -> None:
        kind, value = self.kind, self.value
        if kind == NAME:
            if value == "typeof":
                self.advance()
                if self.at("import"):
                    self.import_type()
                    return
                self.any_name()
                while self.eat("."):
                    if self.kind == PRIVATE:
                        self.advance()
                    else:
                        self.any_name()
                if not self.newline and self.at("<"):
                    self.type_arguments()
                return
            if value == "import":
                self.import_type()
                return
            if value in RESERVED and value not in ("this", "null", "true", "false", "void", "undefined"):
                self.fault("expected a type")
            self.advance()
            while self.eat("."):
                self.any_name()
            if not self.newline and (self.at("<") or self.at("<<")):
                self.type_arguments()
            return
        if kind in (STRING, NUMBER):
            self.advance()
            return
        if kind == TEMPLATE:
            self.type_template()
            return
        if kind == PUNCTUATOR:
            if value == "-":
                self.advance()
                if self.kind != NUMBER:
                    self.fault("expected a number")
                self.advance()
                return
            if value == "(":
                self.advance()
                self.type()
                self.expect(")")
                return
            if value == "[":
                self.advance()
                while not self.eat("]"):
                    self.eat("...")
                    if self.kind == NAME and self.peek()[1] in (":", "?") and self.tuple_label():
                        self.advance()
                        self.eat("?")
                        self.expect(":")
                        self.type()
                    else:
                        self.type()
                        self.eat("?")
                    if not self.at("]"):
                        self.expect(",")
                return
            if value == "{":
                if not self.attempt(self.mapped_type):
                    self.object_type()
                return
        self.fault("expected a type")

    def tuple_label(self) -> bool:
        s = self.state()
        self.advance()
        self.eat("?")
        labelled = self.at(":")
        self.reset(s)
        return labelled

    def type_template(self) -> None:
        text, at = self.text, self.start + 1
        while True:
            at = _TEMPLATE_PART.match(text, at).end()
            if text.startswith("`", at):
                self.pos = at + 1
                self.advance()
                return
            if not text.startswith("${", at):
                raise SyntaxFault("a template does not end", at)
            self.pos = at + 2
            self.advance()
            self.type()
            if not self.at("}"):
                self.fault("expected }")
            at = self.start + 1

    def import_type(self) -> None:
        self.expect("import")
        self.expect("(")
        self.type()
        if self.eat(","):
            self.expression()
        self.expect(")")
        while self.eat("."):
            self.any_name()
        if not self.newline and self.at("<"):
            self.type_arguments()

    def mapped_type(self) -> bool:
        self.expect("{")
        if self.at("+") or self.at("-"):
            self.advance()
            self.expect("readonly")
        elif self.at("readonly") and self.peek()[1] == "[":
            self.advance()
        self.expect("[")
        self.name()
        self.expect("in")
        self.type()
        if self.eat("as"):
            self.type()
        self.expect("]")
        if self.at("+") or self.at("-"):
            self.advance()
            self.expect("?")
        else:
            self.eat("?")
        if self.eat(":"):
            self.type()
        self.eat(";") or self.eat(",")
        self.expect("}")
        return True

    def index_signature(self) -> bool:
        self.expect("[")
        self.name()
        self.expect(":")
        self.type()
        self.expect("]")
        if self.eat(":"):
            self.type()
        return True

    def object_type(self) -> None:
        self.expect("{")
        while not self.eat("}"):
            self.type_member()
            if not (self.eat(";") or self.eat(",") or self.at("}") or self.newline):
                self.fault("expected ;")

    def type_member(self) -> None:
        if self.at("(") or self.at("<"):
            self.signature()
            return
        if self.at("new") and self.peek()[1] in ("(", "<"):
            self.advance()
            self.signature()
            return
        while self.kind == NAME and self.value in ("readonly", "get", "set") and self.peek()[1] not in (":", "?", "(", "<", ",", ";", "}"):
            self.advance()
        if self.at("[") and self.attempt(self.index_signature):
            return
        self.property_name()
        self.eat("?")
        if self.at("(") or self.at("<"):
            self.signature()
        elif self.eat(":"):
            self.type()

    def signature(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.parameters()
        if self.eat(":"):
            self.return_type()


_CALL = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:\??\.\s*([A-Za-z_$][\w$]*)\s*)?(?:\?\.)?\(")
_FREE_NAME = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*")
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_CHARS = re.compile(r"[^<>{}]*")
_TYPE_STATEMENTS = frozenset("interface type enum abstract declare namespace module global".split())
_STATEMENTS = {
    "var": Parser.variable_statement, "let": Parser.variable_statement, "const": Parser.variable_statement,
    "if": Parser.if_statement, "for": Parser.for_statement, "while": Parser.while_statement, "do": Parser.do_statement,
    "break": Parser.jump_statement, "continue": Parser.jump_statement, "return": Parser.return_statement,
    "throw": Parser.throw_statement, "try": Parser.try_statement, "switch": Parser.switch_statement,
    "with": Parser.with_statement, "debugger": Parser.debugger_statement, "function": Parser.function_statement,
    "async": Parser.function_statement, "class": Parser.class_statement, "import": Parser.import_statement,
    "export": Parser.export_statement,
}


def _check_regex(body: str, at: int) -> None:
    """Balance of groups and something to repeat, as the pattern grammar asks."""
    depth, i, repeatable, n = 0, 0, False, len(body)
    while i < n:
        ch = body[i]
        if ch == "\\":
            i += 2
            repeatable = True
            continue
        if ch == "[":
            i += 1
            while i < n and body[i] != "]":
                i += 2 if body[i] == "\\" else 1
            repeatable = True
        elif ch == "(":
            depth += 1
            repeatable = False
            if body.startswith("(?", i):
                m = re.match(r"\(\?(?:[:=!]|<[=!]|<[A-Za-z_$][\w$]*>|[a-z-]+:)", body[i:])
                if m is None:
                    raise SyntaxFault("bad group", at)
                i += m.end()
                continue
        elif ch == ")":
            depth -= 1
            repeatable = True
            if depth < 0:
                raise SyntaxFault("unbalanced group", at)
        elif ch in "*+?":
            if not repeatable:
                raise SyntaxFault("nothing to repeat", at)
            if body[i + 1 : i + 2] == "?":
                i += 1
            repeatable = False
        elif ch == "|":
            repeatable = False
        elif ch == "{" and (m := re.match(r"\{\d+(?:,\d*)?\}\??", body[i:])):
            if not repeatable:
                raise SyntaxFault("nothing to repeat", at)
            i += m.end()
            repeatable = False
            continue
        else:
            repeatable = ch not in "^"
        i += 1
    if depth:
        raise SyntaxFault("unbalanced group", at)


#: Calls within calls that nesting may take, some ten a level; two kilobytes a level are held.
MOST_NESTED = 2_000_000


def parse(text: str, jsx: bool = False, types: bool = False, events: bool = False) -> list[Definition]:
    """The definitions, and events if asked for, of a text in source order; raises :class:`SyntaxFault` where it leaves the grammar."""
    limit = sys.getrecursionlimit()
    if limit < MOST_NESTED:
        sys.setrecursionlimit(MOST_NESTED)
    parser = None
    try:
        parser = Parser(text, jsx, types, events=events)
        return parser.program()
    except RecursionError:
        raise TooDeep("nested too deeply", 0) from None
    except SyntaxFault as fault:
        # of several readings that failed, the one that came furthest tells best what is wrong
        best = parser.furthest if parser else None
        raise (best if best is not None and best.position > fault.position else fault) from None


def is_valid(text: str, jsx: bool = False, types: bool = False) -> bool:
    """Whether a text follows the grammar."""
    try:
        parse(text, jsx, types)
    except SyntaxFault:
        return False
    return True


__all__ = ["Definition", "Parser", "SyntaxFault", "is_valid", "parse"]
