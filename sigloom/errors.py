"""What can stop a run."""

from __future__ import annotations


class RuleBroken(ValueError):
    """The first broken rule of an entity."""

    def __init__(self, entity: str, rule: str):
        self.entity, self.rule = entity, rule
        super().__init__(f"{entity}: {rule}")


class RequestsUnknown(ValueError):
    """Requests no recipe answers to, all of them, and the names that are known."""

    def __init__(self, requests: tuple[str, ...], known: tuple[str, ...]):
        self.requests, self.known = requests, known
        super().__init__(f"no recipe for {', '.join(map(repr, requests))}; known: {', '.join(known)}")


class RunIncomplete(RuntimeError):
    """A manifest was written, but not every cell is complete."""

    def __init__(self, cells: tuple[str, ...], manifest: str):
        self.cells, self.manifest = cells, manifest
        super().__init__(f"incomplete: {', '.join(cells)}; manifest: {manifest}")
