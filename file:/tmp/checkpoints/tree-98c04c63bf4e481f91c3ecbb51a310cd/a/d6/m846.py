x846