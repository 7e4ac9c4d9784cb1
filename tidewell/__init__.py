"""tidewell: a content-intelligence engine written as Spark logical plans."""
