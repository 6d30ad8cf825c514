"""orbitweave: Spark-native building blocks for irregular Earth-observation style records."""
