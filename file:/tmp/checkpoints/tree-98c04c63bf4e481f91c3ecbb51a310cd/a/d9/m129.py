x129