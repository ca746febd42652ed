"""Feature names, groups and the families that provide them.

A selection is a list of names, or comma-separated text; names are upper-cased, empty items are forgiven, a leading `-` takes away.
Groups are written *NAME*.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from roiforge.operators import firstorder, geometry, imagequality, shape, spatial, texture, volume


@dataclass(frozen=True)
class Family:
    """What provides a set of features: their names, whether they are of volumes, and the families computed before."""

    name: str
    features: tuple[str, ...]
    three_d: bool = False
    requires: tuple[str, ...] = ()
    angled: bool = False


def _families() -> dict[str, Family]:
    found = [
        Family("intensity", (*firstorder.INTENSITY, "HISTOGRAM")),
        Family("ih", firstorder.IH),
        Family("morphology", shape.MORPHOLOGY),
        Family("ellipse", shape.ELLIPSE),
        Family("extrema", shape.EXTREMA),
        Family("euler", ("EULER_NUMBER",)),
        Family("boxcount", ("FRACT_DIM_BOXCOUNT",)),
        Family("shape_moments", tuple(shape.moment_names(shape.SHAPE_NAMES))),
        Family("intensity_moments", tuple(shape.moment_names(shape.INTENSITY_NAMES))),
        Family("neighbours", spatial.NEIGHBOURS, requires=("morphology",)),
        Family("polygons", geometry.POLYGONS, requires=("neighbours", "contour", "hull", "caliper")),
        Family("focus", imagequality.FOCUS),
        Family("saturation", imagequality.SATURATION),
        Family("intensity3", tuple(f"3{n}" for n in firstorder.INTENSITY), True),
        Family("shape3", volume.SHAPE3, True),
    ]
    for name, columns in geometry.GROUPS.items():
        plain = {"radial": ("FRAC_AT_D", "MEAN_FRAC", "RADIAL_CV"), "gabor": ("GABOR",), "zernike": ("ZERNIKE2D",)}.get(name, columns)
        found.append(Family(name, plain, requires=("contour",) if name in ("hull", "fractal", "circles", "geodetic", "radius", "radial") else ()))
    for kind in ("GLCM", "GLRLM", "GLSZM", "GLDZM", "GLDM", "NGLDM", "NGTDM"):
        for three_d in (False, True):
            angled = kind in ("GLCM", "GLRLM")
            found.append(Family(kind.lower() + ("3" if three_d else ""), tuple(texture.names(kind, three_d)), three_d, angled=angled))
            if angled:
                found.append(Family(kind.lower() + ("3" if three_d else "") + "_ave", tuple(texture.names(kind, three_d, True)), three_d))
    return {f.name: f for f in found}


FAMILIES = _families()
PROVIDER = {n: f.name for f in FAMILIES.values() for n in f.features}
_SHAPE = ("morphology", "ellipse", "extrema", "euler", "boxcount", *(g for g in geometry.GROUPS if g in ("contour", "hull", "erosion", "fractal", "caliper", "chords", "circles", "geodetic", "radius")), "polygons")
_MOMENTS = ("shape_moments", "intensity_moments", "weighted_moments", "weighted_intensity_moments")
_TEXTURE = ("glcm", "glcm_ave", "glrlm", "glrlm_ave", "glszm", "gldzm", "gldm", "ngldm", "ngtdm")
_QUALITY = ("focus", "saturation", "sharpness", "spectrum")
GROUPS: dict[str, tuple[str, ...]] = {
    "*ALL_INTENSITY*": ("intensity",), "*ALL_MORPHOLOGY*": _SHAPE, "*BASIC_MORPHOLOGY*": ("morphology",), "*ALL_GLCM*": ("glcm", "glcm_ave"), "*ALL_GLRLM*": ("glrlm", "glrlm_ave"), "*ALL_GLSZM*": ("glszm",), "*ALL_GLDZM*": ("gldzm",),
    "*ALL_GLDM*": ("gldm",), "*ALL_NGLDM*": ("ngldm",), "*ALL_NGTDM*": ("ngtdm",), "*ALL_NEIGHBOR*": ("neighbours",), "*ALL_IMQ*": _QUALITY, "*WHOLESLIDE*": ("intensity", "morphology", *_TEXTURE),
    "*ALL*": tuple(f.name for f in FAMILIES.values() if not f.three_d and f.name not in ("ih", *_QUALITY)),
    "*ALL_BUT_GABOR*": tuple(f.name for f in FAMILIES.values() if not f.three_d and f.name not in ("ih", "gabor", *_QUALITY)),
    "*ALL_BUT_GLCM*": tuple(f.name for f in FAMILIES.values() if not f.three_d and f.name not in ("ih", "glcm", "glcm_ave", *_QUALITY)),
    "*3D_ALL_INTENSITY*": ("intensity3",), "*3D_ALL_MORPHOLOGY*": ("shape3",), "*3D_ALL*": tuple(f.name for f in FAMILIES.values() if f.three_d),
    "*3D_GLCM*": ("glcm3", "glcm3_ave"), "*3D_GLRLM*": ("glrlm3", "glrlm3_ave"), "*3D_GLSZM*": ("glszm3",), "*3D_GLDZM*": ("gldzm3",), "*3D_GLDM*": ("gldm3",), "*3D_NGLDM*": ("ngldm3",), "*3D_NGTDM*": ("ngtdm3",),
}


def resolve(selection: str | Iterable[str], ibsi: bool = False) -> list[str]:
    """Feature names of a selection, in the registry's order; unknown names are an error. Histogram features of the standard come with ibsi only."""
    items = selection.split(",") if isinstance(selection, str) else list(selection)
    chosen: set[str] = set()
    for item in (x.strip().upper() for x in items):
        if not item:
            continue
        away, name = item.startswith("-"), item.lstrip("+-")
        if name in GROUPS:
            names = {n for f in GROUPS[name] for n in FAMILIES[f].features}
        elif name in PROVIDER:
            names = {name}
        else:
            raise ValueError(f"unknown feature or group: {name}")
        chosen = chosen - names if away else chosen | names
    return [n for n in PROVIDER if n in chosen and (ibsi or PROVIDER[n] != "ih")]


def ordered_families(features: Iterable[str]) -> list[str]:
    """Families of the features and those they require, each after its requirements; a cycle is an error."""
    done: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise ValueError(f"families require one another: {name}")
        open_.add(name)
        for r in FAMILIES[name].requires:
            visit(r)
        open_.discard(name)
        done.append(name)

    for f in features:
        visit(PROVIDER[f])
    return done


@dataclass
class UserFamilies:
    """Families that users add: a name, the columns, and a function from pixels to one row a region."""

    functions: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, features: Iterable[str], requires: Iterable[str] = ()) -> Callable:
        """Decorator: function(pixels) -> DataFrame of the keys and the features."""

        def add(function: Callable) -> Callable:
            names = tuple(n.upper() for n in features)
            taken = [n for n in names if n in PROVIDER]
            if taken or name in FAMILIES:
                raise ValueError(f"already provided: {name} {taken}")
            FAMILIES[name] = Family(name, names, requires=tuple(requires))
            PROVIDER.update(dict.fromkeys(names, name))
            self.functions[name] = function
            return function

        return add


USER = UserFamilies()
register_feature = USER.register
