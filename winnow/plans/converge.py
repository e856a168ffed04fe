"""What an iteration owes its caller: a certified result or an error."""

from __future__ import annotations


class NotConverged(ArithmeticError):
    """An iteration ended at its round limit before its result was certified."""


def require(done: bool, what: str, gap: float, rounds: int) -> None:
    if not done:
        raise NotConverged(f"{what}: gap {gap:.3g} after {rounds} rounds; raise the limit or the tolerance")
