x375