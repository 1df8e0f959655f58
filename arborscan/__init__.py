"""Forest-change analytics on Spark DataFrames.

``functions``  Column expressions (names, bands, probabilities, rings, CRS, chips)
``operators``  DataFrame -> DataFrame steps
``sources``    readers and writers
``plans``      whole jobs composed from operators
``streaming``  incremental variants on Structured Streaming
``queries``    the registered checks over the shared test tables
"""
