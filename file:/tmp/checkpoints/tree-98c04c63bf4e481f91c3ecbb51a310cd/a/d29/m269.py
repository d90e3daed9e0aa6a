x269