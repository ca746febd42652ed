"""Image-feature analytics on Spark: labelled pixels in, one wide row of features per region out."""
