x753