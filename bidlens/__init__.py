"""Ad-auction log analytics as Spark DataFrame plans."""
