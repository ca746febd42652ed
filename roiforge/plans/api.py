"""The library's face: settings, featurize(), and classes for slides, volumes, image quality and nested regions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roiforge.functions.sqltext import KEYS, run
from roiforge.functions.store import stored
from roiforge.operators import firstorder, geometry, imagequality, outline, output, shape, spatial, texture, volume
from roiforge.operators.zones import Zones, features_of, labelled
from roiforge.plans.registry import FAMILIES, PROVIDER, USER, ordered_families, resolve
from roiforge.session import ship


@dataclass(frozen=True)
class Settings:
    """Parameters of all families. coarse_gray_depth > 0: matlab levels, < 0: radiomics bins, 0 or ibsi: intensities as they are.

    depths: grey depths of single families (glcm, 3gldm, ...) that differ from it. background: in GLRLM, GLSZM, GLDZM and NGTDM the cells of a region's
    box that aren't its own count as level 1 (with matlab levels). gldzm_straight: distance zones are 4-connected. level_index: DIFVAR and JVAR take
    levels' numbers (with radiomics bins). intensity_mode, min_intensity, max_intensity and dynamic_range say how images' values become
    intensities, see quantised(). merge_labels: all labels of an image are one region. glcm_angles: directions of GLCM in 2D. annotation_separator
    divides the annotations in masks' names. glcm3_angles and glcm3_sparse_intensities are kept and reported, but change nothing: all 13 directions
    are taken, and only the levels that occur.
    """

    neighbor_distance: int = 5
    pixels_per_micron: float = 1.0
    coarse_gray_depth: int = 64
    glcm_offset: int = 1
    glcm_symmetric: bool = False
    glcm_angles: tuple[int, ...] = (0, 45, 90, 135)
    annotation_separator: str = "_"
    histogram_bins: int = 64
    local_focus_scale: int = 2
    ibsi: bool = False
    anisotropy: tuple[float, float, float] = (1.0, 1.0, 1.0)
    noval: float = 0.0
    depths: tuple[tuple[str, int], ...] = ()
    glcm3_offset: int = 1
    glcm3_angles: int = 13
    glcm3_sparse_intensities: bool = False
    ngtdm3_radius: int = 1
    background: bool = False
    gldzm_straight: bool = False
    level_index: bool = True
    merge_labels: bool = False
    intensity_mode: str = "auto"
    min_intensity: float | None = None
    max_intensity: float | None = None
    dynamic_range: int = 10_000
    gabor_kersize: int = 16
    gabor_gamma: float = 0.1
    gabor_sig2lam: float = 0.8
    gabor_f0: float = 0.1
    gabor_thold: float = 0.025
    gabor_thetas: tuple[float, ...] = (0.0, 45.0, 90.0, 135.0)
    gabor_freqs: tuple[float, ...] = (4.0, 16.0, 32.0, 64.0)

    def __post_init__(self) -> None:
        positive = {"neighbor_distance": self.neighbor_distance, "pixels_per_micron": self.pixels_per_micron, "glcm_offset": self.glcm_offset, "glcm3_offset": self.glcm3_offset, "ngtdm3_radius": self.ngtdm3_radius, "dynamic_range": self.dynamic_range, **dict(zip(("anisotropy_x", "anisotropy_y", "anisotropy_z"), self.anisotropy, strict=True))}
        wrong = [n for n, v in positive.items() if v <= 0]
        if wrong:
            raise ValueError(f"must be greater than zero: {', '.join(wrong)}")
        if not self.glcm_angles or set(self.glcm_angles) - {0, 45, 90, 135} or not self.annotation_separator:
            raise ValueError("glcm_angles must be among 0, 45, 90 and 135, and annotation_separator a text")
        if len(self.gabor_thetas) != len(self.gabor_freqs):
            raise ValueError("as many gabor_thetas as gabor_freqs are needed")

    @property
    def depth(self) -> int:
        return 0 if self.ibsi else self.coarse_gray_depth

    def depth_of(self, family: str) -> int:
        """The grey depth of a family as users call it: glcm, 3glcm, ..."""
        return 0 if self.ibsi else dict(self.depths).get(family, self.coarse_gray_depth)

    @property
    def geometry(self) -> dict[str, dict]:
        return {"gabor": {"pairs": tuple(zip(self.gabor_thetas, self.gabor_freqs, strict=True)), "n": self.gabor_kersize, "gamma": self.gabor_gamma, "sig2lam": self.gabor_sig2lam, "low": self.gabor_f0, "threshold": self.gabor_thold}}


#: family/parameter names as users write them, besides family/greydepth
_METAPARAMETERS = {"glcm/offset": "glcm_offset", "3glcm/offset": "glcm3_offset", "3glcm/numang": "glcm3_angles", "3glcm/sparseintensities": "glcm3_sparse_intensities", "3ngtdm/radius": "ngtdm3_radius"}
_DEPTH_FAMILIES = tuple(f"{d}{f}" for d in ("", "3") for f in ("glcm", "glrlm", "glszm", "gldzm", "gldm", "ngldm", "ngtdm"))


def _wide(long: DataFrame, names: Sequence[str], only: Sequence[int] = ()) -> DataFrame:
    """Features by direction (column a) as one column for each feature and direction."""
    angles = [a for a, *_ in (texture.ANGLES_3D if names[0].startswith("3") else texture.ANGLES) if not only or a in only]
    return long.groupBy(*KEYS).agg(*[F.max(F.when(F.col("a") == a, F.col(f"`{n}`"))).alias(f"{n}_{a}") for n in names for a in angles])


#: Families that bin intensities to grey levels and draw on nothing else.
_LEVELLED = ("glcm", "glrlm", "gldm", "ngtdm", "glszm", "gldzm")


def _plain(name: str) -> tuple[str, bool]:
    """A texture family's name without dimension and average, and whether it is of volumes."""
    return name.removesuffix("_ave").rstrip("3"), name.removesuffix("_ave").endswith("3")


class Shared:
    """Relations that several of the asked families draw on, each computed once and written: grey levels by depth, with the region's extrema, and zones.

    A relation that only one family needs is left to its plan.
    """

    def __init__(self, pixels: DataFrame, families: Sequence[str], s: Settings) -> None:
        self.pixels, self.s, self._levels, self._zones = pixels, s, {}, {}
        uses = [self._key(f) for f in families if _plain(f)[0] in _LEVELLED and f not in USER.functions]
        self._common = {k for k in uses if uses.count(k) > 1}
        self._both = {k for k in (self._zone_key(f) for f in families if _plain(f)[0] == "glszm") if k in [self._zone_key(f) for f in families if _plain(f)[0] == "gldzm"]}

    def outside(self, name: str) -> bool:
        """Whether background counts: with levels from 1 on, in families of images that take it."""
        plain, three_d = _plain(name)
        return self.s.background and self._depth(name) > 0 and not three_d and plain in ("glrlm", "glszm", "gldzm", "ngtdm")

    def _depth(self, name: str) -> int:
        plain, three_d = _plain(name)
        return self.s.depth_of(("3" if three_d else "") + plain)

    def _key(self, name: str) -> tuple[int, bool]:
        return self._depth(name), self.outside(name)

    def _zone_key(self, name: str) -> tuple:
        plain, three_d = _plain(name)
        return *self._key(name), three_d, plain == "gldzm" and self.s.gldzm_straight

    def _of(self, name: str) -> DataFrame:
        return run(self.pixels, texture.background_sql()) if self.outside(name) else self.pixels

    def levels(self, name: str) -> DataFrame | None:
        """The family's grey levels if another family shares them."""
        key = self._key(name)
        if key not in self._common:
            return None
        if key not in self._levels:
            self._levels[key] = stored(run(self._of(name), texture.all_levels_sql(key[0])), "levels")
        return self._levels[key]

    def run(self, name: str, text: str) -> DataFrame:
        """A family's text over its pixels, or over the shared levels."""
        levels = self.levels(name)
        if levels is None:
            return run(self._of(name), text)
        return run(self.pixels, texture.on_levels(text, self._depth(name), not self.outside(name)), levels=levels)

    def zones(self, name: str) -> Zones:
        key = self._zone_key(name)
        if key not in self._zones:
            levels = self.levels(name)
            own = run(self._of(name), texture.levels_sql(key[0], key[1])) if levels is None else levels.where(F.lit(True) if key[1] else F.col("i") != 0).select(*KEYS, "x", "y", "z", "g")
            self._zones[key] = labelled(own, key[2], key[3], keep=key in self._both)
        return self._zones[key]


def family_frame(pixels: DataFrame, name: str, s: Settings, done: dict[str, DataFrame], shared: Shared | None = None) -> DataFrame:
    """One family's features, one row a region."""
    shared = shared or Shared(pixels, [name], s)
    if name in USER.functions:
        function = USER.functions[name]
        needs = FAMILIES[name].requires
        return function(pixels, {r: done[r] for r in needs}) if needs else function(pixels)
    plain, three_d = _plain(name)
    depth = s.depth_of(("3" if three_d else "") + plain)
    outside = shared.outside(name)
    ave = name.endswith("_ave")
    simple = {
        "ih": lambda: firstorder.ih_sql(s.histogram_bins), "morphology": lambda: shape.morphology_sql(1 / s.pixels_per_micron), "ellipse": shape.ellipse_sql, "extrema": shape.extrema_sql, "euler": shape.euler_sql, "boxcount": shape.box_counts_sql,
        "shape_moments": lambda: shape.moments_sql("1e0", shape.SHAPE_NAMES), "intensity_moments": lambda: shape.moments_sql("cast(a.inten as double)", shape.INTENSITY_NAMES), "neighbours": lambda: spatial.neighbours_sql(s.neighbor_distance),
        "focus": lambda: imagequality.focus_sql(s.local_focus_scale), "saturation": imagequality.saturation_sql, "intensity3": lambda: firstorder.intensity_sql(abs(s.coarse_gray_depth) or 64, "3"),
        "gldm": lambda: texture.gldm_sql(depth), "gldm3": lambda: texture.gldm_sql(depth, True), "ngldm": lambda: texture.ngldm_sql(abs(depth)), "ngldm3": lambda: texture.ngldm3_sql(abs(depth)),
        "ngtdm": lambda: texture.ngtdm_sql(depth, background=outside), "ngtdm3": lambda: texture.ngtdm_sql(depth, True, radius=s.ngtdm3_radius),
    }
    if name in simple:
        return shared.run(name, simple[name]()) if plain in _LEVELLED else run(pixels, simple[name]())
    if name == "intensity":
        bins = run(pixels, firstorder.histogram_sql(s.histogram_bins))
        return run(pixels, firstorder.intensity_sql(abs(s.coarse_gray_depth) or 64)).join(bins, list(KEYS))
    if plain in ("glcm", "glrlm"):
        only = s.glcm_angles if plain == "glcm" and not three_d else ()
        text = texture.glcm_sql(depth, s.glcm3_offset if three_d else s.glcm_offset, s.glcm_symmetric, three_d, ave, by_index=s.level_index and depth < 0, only=only) if plain == "glcm" else texture.glrlm_sql(depth, three_d, ave, background=outside)
        long = shared.run(name, text)
        return long if ave else _wide(long, texture.names(plain.upper(), three_d), only)
    if plain in ("glszm", "gldzm"):
        return features_of(shared.zones(name), plain.upper(), three_d)
    if name == "shape3":
        return volume.shape3(pixels)
    if name == "polygons":
        return geometry.polygonality(done["neighbours"], done["contour"])
    raise ValueError(f"no such family: {name}")


def _columns(name: str, frame: DataFrame, wanted: set[str]) -> list[str]:
    """The frame's columns of wanted features; a feature of several values has several columns."""
    found = []
    for c in frame.columns:
        if c in KEYS:
            continue
        base = max((f for f in FAMILIES[name].features if c == f or c.startswith(f + "_")), key=len, default=None)
        if base in wanted:
            found.append(c)
    return found


def featurize(pixels: DataFrame, features: str | Iterable[str] = "*ALL*", settings: Settings | None = None) -> DataFrame:
    """One row a region (slide_id, t, label) with the selected features.

    Background (label 0) and null labels are left out. Only the families asked for, and those they require, are planned; each
    is a plan of its own over the same pixels, joined on the region, so unused columns are pruned by the optimizer. What several of them draw on is
    computed once, see Shared.
    """
    s = settings or Settings()
    ship(pixels.sparkSession)
    names = resolve(features, s.ibsi)
    kept = resampled(pixels, s.anisotropy).where("label <> 0 and inten is not null")
    if s.merge_labels:
        kept = kept.withColumn("label", F.lit(1).cast("long"))
    kept = kept.select(*KEYS, "x", "y", "z", "inten")
    done: dict[str, DataFrame] = {}
    order = ordered_families(names)
    groups = [n for n in order if n in geometry.GROUPS]
    if groups:
        # all of geometry in one grouped pass
        whole = outline.geometry(kept, groups, s.noval, s.geometry)
        done |= dict.fromkeys(groups, whole)
    shared = Shared(kept, order, s)
    for name in order:
        if name not in done:
            done[name] = family_frame(kept, name, s, done, shared)
    wanted = set(names)
    shown = [n for n in done if n not in groups and any(PROVIDER[x] == n for x in names)]
    parts = [done[n].select(*KEYS, *[F.col(f"`{c}`") for c in _columns(n, done[n], wanted)]) for n in shown]
    own = [c for g in groups for c in _columns(g, done[g], wanted)]
    if own:
        parts.append(done[groups[0]].select(*KEYS, *[F.col(f"`{c}`") for c in own]))
    base = kept.select(*KEYS).distinct()
    return output.without_nan(reduce(lambda a, b: a.join(b, list(KEYS), "left"), parts, base), s.noval)


def resampled(pixels: DataFrame, anisotropy: tuple[float, float, float]) -> DataFrame:
    """Nearest-neighbour rescaling of coordinates: a virtual pixel v shows the pixel floor(v / a)."""
    for c, a in zip("xyz", anisotropy, strict=True):
        if a != 1:
            first, last = F.ceil(F.col(c) * a), F.ceil((F.col(c) + 1) * a) - 1
            pixels = pixels.where(last >= first).withColumn(c, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return pixels


def _aniso(settings: dict) -> dict:
    """Settings in which anisotropy_x, _y, _z stand for one anisotropy."""
    rest = {k: v for k, v in settings.items() if k not in ("anisotropy_x", "anisotropy_y", "anisotropy_z")}
    if len(rest) < len(settings):
        rest["anisotropy"] = tuple(float(settings.get(f"anisotropy_{c}", 1.0)) for c in "xyz")
    return rest


class SlideFeatures:
    """Features of slides: a selection and settings, applied to arrays, folders, file lists or tables of pixels."""

    three_d = False

    def __init__(self, features: str | Iterable[str] = "*ALL*", spark: SparkSession | None = None, **settings) -> None:
        self.spark = spark or SparkSession.getActiveSession()
        self.features, self.settings, self.blacklist = features, Settings(**_aniso(settings)), ""
        resolve(features, self.settings.ibsi)

    def featurize(self, intensities, labels, intensity_names: Sequence[str] | None = None, mask_names: Sequence[str] | None = None) -> DataFrame:
        """Arrays: one image or a stack of images, and masks of the same shape."""
        from roiforge.sources.arrays import montage

        return self.featurize_pixels(montage(self.spark, intensities, labels, intensity_names, self.three_d))

    def _quantised(self, raw: DataFrame) -> DataFrame:
        from roiforge.sources.images import quantised

        s = self.settings
        return quantised(raw, s.intensity_mode, s.min_intensity, s.max_intensity, s.dynamic_range)

    def _with_names(self, pixels: DataFrame, header: bool) -> DataFrame:
        """Features of images' pixels; with header the leading columns intensity_image, mask_image, annotations, ROI_label and t_index."""
        found = self.featurize_pixels(self._quantised(pixels).drop("mask_image"))
        if not header:
            return found
        slides = pixels.select("slide_id", "mask_image").distinct().select("slide_id", F.element_at(F.split("slide_id", "/"), -1).alias("intensity_image"), F.element_at(F.split("mask_image", "/"), -1).alias("mask_image"))
        return output.with_header_columns(found, slides.withColumn("annots", spatial.annotations_of("mask_image", self.settings.annotation_separator)))

    def featurize_directory(self, intensity_dir: str, label_dir: str | None = None, file_pattern: str = ".*", header: bool = False, metrics_dir: str | None = None) -> DataFrame:
        """Images of a folder and masks of the same names; without masks each image is one region. With metrics_dir each mask's roi_metrics are written there.

        A pattern with {set d+} names the files of z-stacks: {d+} stands for digits, {c+} for letters, and {set d+} for the z index.
        """
        from roiforge.sources.images import image_pixels

        pixels = image_pixels(self.spark, intensity_dir, label_dir, file_pattern, self.three_d)
        if metrics_dir:
            output.write_roi_metrics(spatial.without_blacklisted(self._quantised(pixels), self.blacklist), metrics_dir)
        return self._with_names(pixels, header)

    def featurize_files(self, intensity_files: Sequence[str], mask_files: Sequence[str] = (), single_roi: bool = False, header: bool = False) -> DataFrame:
        """Files of images and masks, one to one; with single_roi masks are ignored. Volumes: one image may have several masks."""
        from roiforge.sources.images import paired_pixels

        images, masks = list(intensity_files), list(mask_files)
        if single_roi:
            masks = images
        elif self.three_d and len(images) == 1:
            images = images * len(masks)
        if len(images) != len(masks):
            raise ValueError("as many masks as images are needed")
        pairs = self.spark.createDataFrame(list(zip(images, masks, strict=True)), "intensity_image string, mask_image string")
        return self._with_names(paired_pixels(self.spark, pairs, single_roi), header)

    def featurize_mapping(self, lines: DataFrame, intensity_dir: str, label_dir: str, header: bool = False) -> DataFrame:
        """Pairs from a mapping file's lines (value): names of an image and its mask."""
        from roiforge.sources.images import paired_pixels

        return self._with_names(paired_pixels(self.spark, spatial.pair_by_file(lines, intensity_dir, label_dir)), header)

    def featurize_zarr(self, store: str, label_store: str | None = None, array: str = "0", channel: int = 0) -> DataFrame:
        """An OME-Zarr image, and one of labels; without labels the image is one region."""
        from roiforge.sources.images import zarr_image_pixels

        return self.featurize_pixels(self._quantised(zarr_image_pixels(self.spark, store, label_store, array, channel)))

    def featurize_pixels(self, pixels: DataFrame) -> DataFrame:
        return featurize(spatial.without_blacklisted(pixels, self.blacklist), self.features, self.settings)

    def blacklist_roi(self, text: str) -> None:
        spatial.parse_blacklist(text)
        self.blacklist = text

    def clear_roi_blacklist(self) -> None:
        self.blacklist = ""

    def roi_blacklist_summary(self) -> str | None:
        everywhere, by_file = spatial.parse_blacklist(self.blacklist)
        parts = [f"global: {', '.join(map(str, sorted(everywhere)))}"] if everywhere else []
        return "\n".join([*parts, *(f"{f}: {', '.join(map(str, sorted(x)))}" for f, x in sorted(by_file.items()))]) or None

    def set_params(self, **settings) -> None:
        if "features" in settings:
            features = settings.pop("features")
            resolve(features, self.settings.ibsi)
            self.features = features
        self.settings = replace(self.settings, **_aniso(settings))

    def set_gabor_feature_params(self, **params) -> None:
        """kersize, gamma, sig2lam, f0, thold, thetas and freqs of the Gabor features."""
        unknown = set(params) - {"kersize", "gamma", "sig2lam", "f0", "thold", "thetas", "freqs"}
        if unknown or not params:
            raise ValueError(f"no such Gabor parameter: {', '.join(sorted(unknown)) or 'none given'}")
        self.set_params(**{f"gabor_{k}": tuple(v) if k in ("thetas", "freqs") else v for k, v in params.items()})

    def get_params(self, *names: str) -> dict:
        known = {f.name: getattr(self.settings, f.name) for f in fields(self.settings)}
        return {n: known[n] for n in names} if names else known

    def set_metaparam(self, text: str) -> None:
        """family/parameter=value, as in glcm/offset=2 or 3gldm/greydepth=32."""
        name, _, value = text.partition("=")
        family, _, parameter = name.strip().lower().partition("/")
        if parameter == "greydepth" and family in _DEPTH_FAMILIES:
            self.set_params(depths=tuple(sorted((dict(self.settings.depths) | {family: int(value)}).items())))
        elif name.strip().lower() in _METAPARAMETERS:
            setting, value = _METAPARAMETERS[name.strip().lower()], value.strip().lower()
            if isinstance(getattr(self.settings, setting), bool):
                if value not in ("true", "false"):
                    raise ValueError(f"{name} is true or false")
                self.set_params(**{setting: value == "true"})
            else:
                self.set_params(**{setting: int(value)})
        else:
            raise ValueError(f"no such parameter: {name}")

    def get_metaparam(self, name: str) -> int | bool:
        family, _, parameter = name.strip().lower().partition("/")
        if parameter == "greydepth" and family in _DEPTH_FAMILIES:
            return self.settings.depth_of(family)
        if name.strip().lower() not in _METAPARAMETERS:
            raise ValueError(f"no such parameter: {name}")
        return getattr(self.settings, _METAPARAMETERS[name.strip().lower()])


class VolumeFeatures(SlideFeatures):
    """Features of volumes."""

    three_d = True

    def __init__(self, features: str | Iterable[str] = "*3D_ALL*", spark: SparkSession | None = None, **settings) -> None:
        super().__init__(features, spark, **settings)


class ImageQuality(SlideFeatures):
    """Quality scores of whole images."""

    def __init__(self, features: str | Iterable[str] = "*ALL_IMQ*", spark: SparkSession | None = None, **settings) -> None:
        super().__init__(features, spark, **settings)


class NestedRois:
    """Regions within regions: relations by containment, and children's features joined to their parents.

    how: an aggregate by name, NONE, a function of a column or of a pandas Series, a dict from feature to one of these, or a list of them and of
    (name, function), see spatial.aggregate_children().
    """

    def __init__(self, how: str | Callable | Sequence | dict[str, str | Callable] = "SUM", least_children: int = 0) -> None:
        self.how, self.least_children = how, least_children

    def find_relations(self, parents: DataFrame, children: DataFrame) -> DataFrame:
        return parents.sparkSession.sql(spatial.containment_sql(), parents=parents, children=children)

    def find_file_relations(self, spark: SparkSession, folder: str, channel_signature: str, parent_channel: int, child_channel: int) -> DataFrame:
        """Relations of masks in a folder whose names differ in their channel number only, as in p0_c1.tif and p0_c0.tif with signature _c."""
        from roiforge.sources.images import files, stored_pixels

        paths = [r[0] for r in files(spark, folder).select("path").collect()]
        pairs = spatial.pair_by_channel(paths, channel_signature, parent_channel, child_channel)

        def masks(k: int) -> DataFrame:
            listed = [(p[0], re.sub("^file:/+", "/", p[k + 1])) for p in pairs]
            return stored_pixels(spark.createDataFrame([(stem, f, f, f, 0) for stem, f in listed], "slide_id string, intensity_image string, mask_image string, mask_name string, shift long"))

        return self.find_relations(masks(0), masks(1))

    def featurize_files(self, engine: SlideFeatures, intensity_dir: str, label_dir: str, channel_signature: str, parent_channel: int, child_channel: int) -> DataFrame:
        """Features of the parents' regions with those of their children's, from images and masks of the same names whose channels differ as in find_file_relations()."""
        from roiforge.sources.images import files

        spark = engine.spark
        paths = [r[0] for r in files(spark, label_dir).select("path").collect()]
        pairs = spatial.pair_by_channel(paths, channel_signature, parent_channel, child_channel)
        found = stored(engine.featurize_directory(intensity_dir, label_dir), "features")
        names = [c for c in found.columns if c not in KEYS]

        def side(k: int) -> DataFrame:
            told = spark.createDataFrame([(p[k + 1].rsplit("/", 1)[-1], p[0]) for p in pairs], "file string, stem string")
            mine = found.withColumn("file", F.element_at(F.split("slide_id", "/"), -1)).join(F.broadcast(told), "file")
            return mine.select(F.col("stem").alias("slide_id"), "t", "label", *[F.col(f"`{c}`") for c in names])

        relations = self.find_file_relations(spark, label_dir, channel_signature, parent_channel, child_channel)
        return self.featurize(relations, side(0), side(1), names)

    def featurize(self, relations: DataFrame, parents: DataFrame, children: DataFrame, features: Sequence[str]) -> DataFrame:
        return spatial.aggregate_children(relations, parents, children, self.how, features, self.least_children)
