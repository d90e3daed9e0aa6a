x843