"""Column-returning helper functions."""

from trackwise.functions.scalar import angle_diff, bucket, entropy_term, smoothed_rate, standard_error

__all__ = ["angle_diff", "bucket", "entropy_term", "smoothed_rate", "standard_error"]
