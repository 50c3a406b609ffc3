"""Operators over ticks, bars and daily tables: DataFrame in, DataFrame out."""
