"""Optimistic transactions: buffered changes that one commit applies and logs as one entry, or none of them."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from ..session import Database


class Conflict(RuntimeError):
    """A revision was not as expected; nothing was changed."""


class TransactionError(RuntimeError):
    pass


class Transactions:
    def __init__(self, db: Database):
        self.db = db
        self.revisions: dict[str, int] = {}
        self.open = False
        self.checks: list[tuple[str, int, int]] = []
        self.changes: list[tuple[str, tuple, int]] = []

    def forbid(self, what: str) -> None:
        if self.open:
            raise TransactionError(f"no {what} inside a transaction")

    def revision(self, entity: str) -> int:
        return self.revisions.get(entity, 0)

    def compare_and_set(self, entity: str, expected: int, new: int) -> None:
        if self.revision(entity) != expected:
            raise Conflict(f"{entity} is at {self.revision(entity)}, not {expected}")
        if new != expected:
            self.db.base.log({"revisions": {entity: new}})
            self.revisions[entity] = new

    def begin(self) -> Transactions:
        if self.open:
            raise TransactionError("transactions don't nest")
        self.open, self.checks, self.changes = True, [], []
        return self

    def _need(self) -> None:
        if not self.open:
            raise TransactionError("there is no transaction")

    def cas(self, entity: str, expected: int, new: int) -> None:
        self._need()
        self.checks.append((entity, expected, new))

    def _buffer(self, name: str, values: tuple, sign: int) -> None:
        self._need()
        if name == "rev" or name in self.db.variadic:
            raise TransactionError(f"{name} can't be changed in a transaction")
        if self.db.arity.get(name) != len(values):
            raise TransactionError(f"{name} has {self.db.arity.get(name)} columns")
        self.changes.append((name, values, sign))

    def add(self, name: str, *values) -> None:
        self._buffer(name, values, 1)

    def delete(self, name: str, *values) -> None:
        self._buffer(name, values, -1)

    def rollback(self) -> None:
        self._need()
        self.open, self.checks, self.changes = False, [], []

    def commit(self) -> None:
        """Checks all revisions in order, then applies the last wish for each tuple; a conflict discards everything."""
        self._need()
        checks, changes = self.checks, self.changes
        self.rollback()
        now = dict(self.revisions)
        for entity, expected, new in checks:
            if now.get(entity, 0) != expected:
                raise Conflict(f"{entity} is at {now.get(entity, 0)}, not {expected}")
            if new != expected:
                now[entity] = new
        last: dict[tuple[str, tuple], int] = {(name, values): sign for name, values, sign in changes}
        changes = [(name, values, sign) for (name, values), sign in last.items()]
        before = self.db.base.snapshot()
        try:
            self.db.apply(changes, note=False)
            self.db.base.log({"changes": changes, "revisions": {k: v for k, v in now.items() if self.revisions.get(k) != v}})
        except Exception:
            self.db.base.own = before
            raise
        self.db.note(changes)
        self.revisions = now
