"""python -m roiforge --intDir=... --segDir=... --outDir=... --features=...: features of a folder's images."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def _numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(",") if x.strip())


def _yes(text: str) -> bool:
    return text.strip().lower() in ("true", "1", "yes", "on")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roiforge")
    p.add_argument("--intDir", required=True, help="folder of intensity images")
    p.add_argument("--segDir", help="folder of masks of the same names; without it each image is one region")
    p.add_argument("--outDir", required=True, help="path to write, its ending decides the format unless --outputType does")
    p.add_argument("--outputType", choices=("separatecsv", "singlecsv", "arrowipc", "parquet"))
    p.add_argument("--resultFname", default="features", help="file name in --outDir with --outputType")
    p.add_argument("--intSegMapDir", help="folder of the mapping file")
    p.add_argument("--intSegMapFile", help="file of pairs: an image's and its mask's name in each line")
    p.add_argument("--filePattern", default=".*")
    p.add_argument("--features", default="*ALL*", help="names and groups, or a file that lists them")
    p.add_argument("--dim", type=int, choices=(2, 3), default=2)
    p.add_argument("--coarseGrayDepth", type=int, default=64)
    p.add_argument("--metaparam", action="append", default=[], help="family/parameter=value, may be repeated")
    p.add_argument("--glcmOff", "--glcmOffset", dest="glcmOff", type=int, default=1)
    p.add_argument("--glcmAngles", type=lambda v: tuple(int(x) for x in v.split(",") if x.strip()), help="directions of GLCM among 0,45,90,135")
    p.add_argument("--pixelDistance", type=int, default=5)
    p.add_argument("--pixelsPerMicron", type=float)
    p.add_argument("--pixelsPerCentimeter", type=float, help="as pixelsPerMicron, ten thousand times as many")
    p.add_argument("--ibsi", nargs="?", const=True, type=_yes, default=False)
    p.add_argument("--mergerois", nargs="?", const=True, type=_yes, default=False, help="all labels of an image are one region")
    p.add_argument("--skiproi", default="", help="labels to leave out, 1,2,3 or f1:1,2;f2:3")
    for name, kind in (("freqs", _numbers), ("theta", _numbers), ("gamma", float), ("sig2lam", float), ("kersize", int), ("f0", float), ("thold", float)):
        p.add_argument(f"--gabor{name}", type=kind)
    p.add_argument("--fpimgdr", type=int, help="dynamic range that real intensities are stretched to")
    p.add_argument("--fpimgmin", type=float)
    p.add_argument("--fpimgmax", type=float)
    p.add_argument("--preserve-hu", dest="hu", nargs="?", const=True, type=_yes, default=False, help="a grey level is a Hounsfield unit")
    for axis in "xyz":
        p.add_argument(f"--aniso{axis}", type=float, default=1.0)
    p.add_argument("--aggr", nargs="?", const=True, type=_yes, default=False, help="one row a slide: means over its regions")
    p.add_argument("--annot", nargs="?", const=True, type=_yes, default=False, help="leading columns: file names, annotations, ROI_label, t_index")
    p.add_argument("--roiMetrics", nargs="?", const=True, type=_yes, default=False, help="areas, boxes, extremes and size classes of each mask's regions besides, as roi_metrics_mask.csv; for folders without a mapping file")
    p.add_argument("--annotsep", default="_", help="what divides annotations in a mask's name")
    p.add_argument("--tinyval", type=float, help="accepted; values divided by nothing are --noval, so no tiny substitute is needed")
    p.add_argument("--embeddedpixelsize", help="accepted; sizes come from --pixelsPerMicron and --aniso")
    p.add_argument("--noval", type=float, default=0.0)
    p.add_argument("--singleFile", action="store_true")
    p.add_argument("--hsig", help="channel signature of nested regions, as _c in p0_c1.tif; writes the relations of the masks instead of features")
    p.add_argument("--hag", type=str.upper, choices=("SUM", "MEAN", "MIN", "MAX", "WMA", "NONE"), help="with --hsig: parents' features with their children's, aggregated so")
    p.add_argument("--hpar", type=int, default=1)
    p.add_argument("--hchi", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    from pathlib import Path

    from roiforge.operators import output
    from roiforge.plans.api import NestedRois, SlideFeatures, VolumeFeatures

    spark = SparkSession.builder.appName("roiforge").getOrCreate()
    ending = {None: "", "separatecsv": ".csv", "singlecsv": ".csv", "arrowipc": ".arrow", "parquet": ".parquet"}[a.outputType]
    target = f"{a.outDir.rstrip('/')}/{a.resultFname}{ending}" if ending else a.outDir
    if a.hsig and not a.hag:
        output.write(NestedRois().find_file_relations(spark, a.segDir, a.hsig, a.hpar, a.hchi), target, single=a.singleFile or a.outputType == "singlecsv")
        return
    features = Path(a.features).read_text().replace("\n", ",") if a.features.endswith(".txt") else a.features
    settings = {"coarse_gray_depth": a.coarseGrayDepth, "glcm_offset": a.glcmOff, "neighbor_distance": a.pixelDistance, "pixels_per_micron": a.pixelsPerMicron or (a.pixelsPerCentimeter or 1e4) / 1e4, "ibsi": a.ibsi, "noval": a.noval, "merge_labels": a.mergerois, "annotation_separator": a.annotsep} | ({"glcm_angles": a.glcmAngles} if a.glcmAngles else {})
    settings |= {"anisotropy": (a.anisox, a.anisoy, a.anisoz), "min_intensity": a.fpimgmin, "max_intensity": a.fpimgmax, "intensity_mode": "hounsfield" if a.hu else "auto"} | ({"dynamic_range": a.fpimgdr} if a.fpimgdr else {})
    engine = (VolumeFeatures if a.dim == 3 else SlideFeatures)(features, spark, **settings)
    gabor = {k: v for k in ("freqs", "gamma", "sig2lam", "kersize", "f0", "thold") if (v := getattr(a, f"gabor{k}")) is not None} | ({"thetas": a.gabortheta} if a.gabortheta else {})
    if gabor:
        engine.set_gabor_feature_params(**gabor)
    for text in a.metaparam:
        engine.set_metaparam(text)
    engine.blacklist_roi(a.skiproi)
    by_pair = a.outputType == "separatecsv" and not a.aggr and not a.hsig
    header = (a.annot or by_pair) and not a.aggr
    if a.hsig:
        found = NestedRois(a.hag).featurize_files(engine, a.intDir, a.segDir, a.hsig, a.hpar, a.hchi)
        output.write(found, target, single=a.singleFile or a.outputType == "singlecsv", noval=a.noval)
        return
    if a.intSegMapFile:
        lines = spark.read.text(f"{(a.intSegMapDir or '.').rstrip('/')}/{a.intSegMapFile}")
        found = engine.featurize_mapping(lines, a.intDir, a.segDir, header)
    else:
        found = engine.featurize_directory(a.intDir, a.segDir, a.filePattern, header, str(Path(target).parent) if a.roiMetrics else None)
    if a.aggr:
        found = output.slide_means(found, [c for c, t in found.dtypes if t == "double"])
    if by_pair:
        if not a.annot:
            found = found.drop(*[c for c in found.columns if c.startswith("anno") and c[4:].isdigit()])
        output.write_by_pair(found, a.outDir, a.noval)
        return
    output.write(found, target, single=a.singleFile or a.outputType == "singlecsv", per_slide=a.outputType == "separatecsv" and not header, noval=a.noval)


if __name__ == "__main__":
    main()
