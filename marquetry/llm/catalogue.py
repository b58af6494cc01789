"""What the subpackage adds to the driver's entry points."""

from __future__ import annotations

import re

from marquetry.llm import queries as _q
from marquetry.llm.oracles import ORACLES as ORACLES

QUERIES = {k: f for k, f in vars(_q).items() if re.match(r"p\d+_", k) and callable(f)}
