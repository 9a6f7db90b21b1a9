"""Operations of a large-scale training-data pipeline, as Spark jobs.

One module per operator; ``queries`` registers them. Nothing else in the library imports this
package, so it can be removed as a whole.
"""
