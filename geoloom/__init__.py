"""geoloom: spatial, temporal, mesh and raster analytics as DataFrame operators."""
