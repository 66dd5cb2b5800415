"""Arguments of parallel loops: what is reached, through which map slot, and how it is used."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from meshloom.operators.model import Dat, MeshMap


class Access(Enum):
    READ, WRITE, RW, INC, MIN, MAX, WORK = range(7)


READ, WRITE, RW, INC, MIN, MAX, WORK = Access


@dataclass(frozen=True, eq=False)
class DatArg:
    dat: Dat
    access: Access
    idx: int = -1
    map: MeshMap | None = None
    on: bool = True
    dim: int | None = None
    type: str | None = None

    @property
    def slots(self) -> list[int]:
        """The map slots; a negative index -k stands for the first k."""
        return [self.idx] if self.idx >= 0 else list(range(-self.idx))


@dataclass(frozen=True, eq=False)
class GlobalArg:
    values: tuple
    access: Access
    on: bool = True
    type: str = "double"

    @property
    def dim(self) -> int:
        return len(self.values)


@dataclass(frozen=True, eq=False)
class IndexArg:
    idx: int = -1
    map: MeshMap | None = None


@dataclass(frozen=True, eq=False)
class InfoArg:
    """The payload of the element that decided the MIN or MAX argument at position ``ref``."""

    values: tuple
    ref: int


def arg_dat(dat: Dat, idx: int = -1, map: MeshMap | None = None, access: Access = READ, dim: int | None = None, type: str | None = None) -> DatArg:
    return DatArg(dat, access, idx, map, True, dim, type)


def opt_arg_dat(on: bool, dat: Dat, idx: int = -1, map: MeshMap | None = None, access: Access = READ) -> DatArg:
    return DatArg(dat, access, idx, map, bool(on))


def _values(data: Any) -> tuple:
    return tuple(data) if isinstance(data, (list, tuple)) else (data,)


def arg_gbl(data, access: Access = READ, type: str = "double") -> GlobalArg:
    return GlobalArg(_values(data), access, True, type)


def opt_arg_gbl(on: bool, data, access: Access = READ, type: str = "double") -> GlobalArg:
    """Off also where there is no data."""
    return GlobalArg(() if data is None else _values(data), access, bool(on) and data is not None, type)


def arg_idx(idx: int = -1, map: MeshMap | None = None) -> IndexArg:
    return IndexArg(idx, map)


def arg_info(data, ref: int) -> InfoArg:
    return InfoArg(_values(data), ref)
