"""Where a deployment's tables are: given paths, else the environment's, else folders under a root."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

#: Names of the tables and outputs, and their places under the root.
PLACES = {
    "policies": "registers/policies", "clauses": "registers/clauses", "exclusions": "registers/exclusions", "history": "registers/history", "register": "registers/fnol", "matrix": "catalogues/matrix.json", "fields": "catalogues/fields.csv",
    "intake": "output/intake", "triage": "output/triage", "index": "index",
}
PREFIX = "LOSSGRID_"


@dataclass(frozen=True)
class Settings:
    """Paths by name. A path with a scheme or from the root of a file system stays as it is, others stand under root."""

    root: str
    given: Mapping[str, str]

    def path(self, name: str) -> str:
        if name not in PLACES:
            raise KeyError(f"{name}: not one of {', '.join(PLACES)}")
        own = self.given.get(name) or PLACES[name]
        return own if "://" in own or own.startswith("/") else f"{self.root.rstrip('/')}/{own}"

    def of_claim(self, name: str, fnol_id: str) -> str:
        """The folder of one claim's output; the register keeps it beside the claim."""
        return f"{self.path(name)}/{fnol_id}"


def settings(root: str, given: Mapping[str, str] | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """given goes before the environment (LOSSGRID_POLICIES and so on), blank values count as none."""
    env = os.environ if env is None else env
    found = {name: (given or {}).get(name, "").strip() or env.get(PREFIX + name.upper(), "").strip() for name in PLACES}
    return Settings(root, {k: v for k, v in found.items() if v})
