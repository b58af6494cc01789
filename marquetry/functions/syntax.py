"""Does a text parse as Python? Decided by the running interpreter's parser, whose own limits are never taken for errors."""

from __future__ import annotations

import ast
import warnings

try:  # parses and builds symbol tables without making objects of the tree, so it accepts a valid text sooner
    from _symtable import symtable as _quick
except ImportError:  # pragma: no cover
    _quick = None

# Messages of limits that the interpreter sets itself, none of them a rule of the language.
_LIMITS = ("too many nested parentheses", "too many levels of indentation", "Parser stack overflowed")


def _limit(e: Exception) -> bool:
    return any(x in str(e) for x in _LIMITS)


def python_parses(text: str) -> bool | None:
    """Is the text a syntactically valid module for the running Python? None where its parser gives up by a limit of its own.

    The tree is built after the grammar has accepted the text, so a tree too deep to be walked means that the text is valid. A
    process that is out of memory raises, as that says nothing about the text.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for parse in (lambda: _quick(text, "", "exec"), lambda: compile(text, "", "exec", ast.PyCF_ONLY_AST, True)) if _quick else (lambda: compile(text, "", "exec", ast.PyCF_ONLY_AST, True),):
            try:
                parse()
                return True
            except RecursionError:
                return True
            except MemoryError as e:
                if not _limit(e):
                    raise
                return None
            except (SyntaxError, ValueError, TypeError) as e:  # of the first parse: may also be an error of scopes, which is none of syntax
                error = e
    return None if _limit(error) else False
