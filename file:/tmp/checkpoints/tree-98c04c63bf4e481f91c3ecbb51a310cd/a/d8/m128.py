x128