x263