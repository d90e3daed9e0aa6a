x234