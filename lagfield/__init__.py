"""lagfield: Spark-native dynamic image correlation. The names below are the usual way in; the corpus operators are apart, in ``lagfield.llm``."""

from .functions.grid import Grid, blackman, blackman_harris, central_cross, qgrid, sector_weight, sphere_form_factor
from .functions.lags import fibonacci, logspace_int
from .functions.models import MODELS, Hint, Model
from .operators.fit import fit_curves, fit_multik
from .operators.isf import intermediate_scattering
from .operators.merge import melt, mergesort, resample
from .operators.noise import noise_of
from .operators.radial import radial, radial_slices
from .operators.temporal import structure_function, structure_slices
from .sources.container import load, save_radial, save_sf
from .sources.tiff import read_images, read_metadata, save_slices

__all__ = ["MODELS", "Grid", "Hint", "Model", "blackman", "blackman_harris", "central_cross", "fibonacci", "fit_curves", "fit_multik", "intermediate_scattering", "load", "logspace_int", "melt", "mergesort", "noise_of", "qgrid", "radial", "radial_slices", "read_images", "read_metadata", "resample", "save_radial", "save_sf", "save_slices", "sector_weight", "sphere_form_factor", "structure_function", "structure_slices"]
