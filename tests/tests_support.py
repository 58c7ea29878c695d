import math

import numpy as np

from assayloom.dataset import Dataset


def dataset(spark, x, scale="log2", **meta):
    x = np.asarray(x, float)
    values = spark.createDataFrame([(f"s{i}", f"F{j}", None if math.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "sample_id string, feature_id string, value double")
    names = list(meta)
    samples = spark.createDataFrame([(f"s{i}", i, *[meta[k][i] for k in names]) for i in range(len(x))], ["sample_id", "sample_ord", *names])
    features = spark.createDataFrame([(f"F{j}", j) for j in range(x.shape[1])], "feature_id string, feature_ord int")
    return Dataset(values, samples, features, scale)
