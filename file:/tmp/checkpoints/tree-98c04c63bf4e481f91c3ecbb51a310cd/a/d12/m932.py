x932