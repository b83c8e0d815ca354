"""Operators of a large training-data pipeline; one module per operator.

``queries`` binds each of them to the given tables.  Nothing outside this
package imports it.
"""
