"""Record linkage on person names as DataFrame operations, with a training-data toolbox."""
