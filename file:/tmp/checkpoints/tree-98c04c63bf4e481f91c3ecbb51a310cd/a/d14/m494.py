x494