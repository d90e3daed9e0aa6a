x386