"""Reading of one structure string into atoms and bonds."""

from __future__ import annotations

import re

#: Symbols that stand without brackets, with their usual valences; small letters are aromatic.
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "P": [3, 5], "S": [2, 4, 6], "F": [1], "Cl": [1], "Br": [1], "I": [1]}
AROMATIC = ["b", "c", "n", "o", "p", "s", "se", "as"]
#: Bond signs and how many electron pairs they stand for; an aromatic bond counts as one, and its atom for one more.
ORDERS = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 1, "/": 1, "\\": 1}
TOKEN = re.compile(r"(?P<open>\()|(?P<close>\))|(?P<dot>\.)|(?P<bond>[-=#$:/\\])|(?P<ring>%\d\d|\d)|(?P<plain>Cl|Br|[BCNOPSFI]|[bcnops])|(?P<bracket>\[[^\[\]]*\])")
BRACKET = re.compile(r"\[(?P<isotope>\d*)(?P<symbol>[A-Z][a-z]?|se|as|[bcnops]|\*)(?P<chiral>@{0,2}(?:[A-Z]{2}\d+)?)(?P<h>H\d*)?(?P<charge>\+\++|--+|[+-]\d*)?(?::\d+)?\]")

Atom = dict[str, object]


def _bracket(text: str) -> Atom:
    m = BRACKET.fullmatch(text)
    if m is None:
        raise ValueError(f"no atom: {text}")
    charge = m["charge"] or ""
    size = int(charge[1:]) if charge[1:].isdigit() else len(charge)
    symbol = m["symbol"]
    return {"symbol": symbol.capitalize(), "aromatic": symbol in AROMATIC, "charge": -size if charge.startswith("-") else size, "isotope": int(m["isotope"] or 0), "hydrogens": int((m["h"] or "H0")[1:] or 1)}


def read_structure(text: str) -> tuple[list[Atom], list[tuple[int, int, str]]]:
    """(atoms, bonds) of a structure string; a bond is (atom, atom, sign), ``:`` between aromatic atoms, ``-`` where nothing is said. Raises for ill-formed ones.

    Directions of bonds and chirality are read and left out. Hydrogens that are not written are counted by the usual valences.
    """
    atoms: list[Atom] = []
    bonds: list[tuple[int, int, str]] = []
    rings: dict[str, tuple[int, str | None]] = {}
    branches: list[int] = []
    last: int | None = None
    sign: str | None = None

    def bind(a: int, b: int, kind: str | None) -> None:
        both = atoms[a]["aromatic"] and atoms[b]["aromatic"]
        if a == b or any({a, b} == {x, y} for x, y, _ in bonds if x in (a, b)):
            raise ValueError("an atom is bound to itself, or twice to another")
        bonds.append((a, b, ":" if both and kind in (None, ":") else "-" if kind in (None, "/", "\\") else kind))

    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not readable from place {at + 1} on")
        kind, token, at = m.lastgroup, m[0], m.end()
        if kind in ("plain", "bracket"):
            atoms.append(_bracket(token) if kind == "bracket" else {"symbol": token.capitalize(), "aromatic": token in AROMATIC, "charge": 0, "isotope": 0, "hydrogens": None})
            if last is not None:
                bind(last, len(atoms) - 1, sign)
            elif sign:
                raise ValueError("a bond without an atom before it")
            last, sign = len(atoms) - 1, None
        elif last is None:
            raise ValueError(f"{token} without an atom before it")
        elif kind == "bond":
            if sign:
                raise ValueError("two bonds in a row")
            sign = token
        elif kind == "ring":
            name = token.lstrip("%").lstrip("0") or "0"
            if name in rings:
                other, own = rings.pop(name)
                if sign and own and sign != own:
                    raise ValueError(f"ring {name} is closed by another bond")
                bind(other, last, sign or own)
            else:
                rings[name] = (last, sign)
            sign = None
        elif sign:
            raise ValueError("a bond without an atom behind it")
        elif kind == "open":
            branches.append(last)
        elif kind == "close":
            if not branches:
                raise ValueError("a branch is closed that isn't open")
            last = branches.pop()
        else:
            last = None
    if sign or branches or rings or not atoms or last is None:
        raise ValueError("it ends in a bond, in an open branch or ring, or has no atom")
    used = [0] * len(atoms)
    for a, b, kind in bonds:
        used[a] += ORDERS[kind]
        used[b] += ORDERS[kind]
    for atom, n in zip(atoms, used):
        if atom["hydrogens"] is None:
            n += bool(atom["aromatic"])
            atom["hydrogens"] = max(0, next((v - n for v in VALENCES[atom["symbol"]] if v >= n), 0))
    return atoms, bonds
