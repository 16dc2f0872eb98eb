"""DataFrame operators over canonical annotations, detections and images."""
