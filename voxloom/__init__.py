"""Arrays, points, trees and property tables as Spark DataFrames, with the operators of volumetric image analysis on them."""
