"""Which columns of a screen's tables play which role."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ScreenSpec:
    """Column roles. A lineage is a guide (or pair of guides), its barcode and, where there is one, the replicate."""

    guides: tuple[str, ...] = ("protospacer_mapped",)
    barcodes: tuple[str, ...] = ("barcode_mapped",)
    identity: str = "UMI_identity"
    reporter: str = "UMI_reporter"
    samples: tuple[str, ...] = ()
    rep: str | None = None

    @property
    def transcripts(self) -> tuple[str, str]:
        return self.identity, self.reporter

    @property
    def lineage(self) -> list[str]:
        out = [*self.guides, *self.barcodes]
        return out + [self.rep] if self.rep and self.rep not in out else out

    def with_(self, **changes) -> ScreenSpec:
        return replace(self, **changes)


SINGLE = ScreenSpec(samples=("rep",), rep="rep")
DUAL = ScreenSpec(guides=("p1_identity", "p2_identity"), samples=("sample", "rep"), rep="rep")
