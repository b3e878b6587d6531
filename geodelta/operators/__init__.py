"""DataFrame operators: chunk encode and decode, epochs, Doppler codecs, statistics, versions."""
