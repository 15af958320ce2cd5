"""Analytics over streams of detections, written for Spark."""
